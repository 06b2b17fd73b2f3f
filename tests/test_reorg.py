"""Reorganisations against the rule in plain Python."""

import random

import pytest

from tapeline.operators import reorg
from tapeline.streaming import books as live
from tapeline.streaming.lake import drain

SCHEMA = "chain string, arrival long, block_number long, block_hash string, parent_hash string"


def plain(rows, depth):
    """Block by block, with everything held in one dict per chain."""
    held, out = {}, []
    for chain, _, number, hash_, parent in sorted(rows, key=lambda r: (str(r[0]), *r[1:4])):
        own = held.setdefault(chain, {})
        while len(own) >= depth:
            own.pop(min(own))
        if own.get(number - 1) not in (None, parent):
            out.append((chain, number, number - 1, own[number - 1], parent))
            for n in [n for n in own if n >= number - 1]:
                own.pop(n)
        else:
            own[number] = hash_
    return out


def forked(rng, chain, count, deepest):
    """A chain that now and then goes back some blocks and on with another branch."""
    rows, number, branch, parent = [], rng.randrange(50), 0, "g"
    hashes = {}
    for at in range(count):
        if rng.random() < 0.03 and number > 2:
            number = max(1, number - rng.randrange(1, deepest))
            branch += 1
            parent = hashes.get(number - 1, "g") if rng.random() < 0.5 else "odd"
        if rng.random() < 0.02:
            number += rng.randrange(1, 4)  # blocks that never came
        hash_ = f"{branch}:{number}"
        rows.append((chain, at * 10, number, hash_, parent))
        hashes[number], parent = hash_, hash_
        number += 1
    return rows


@pytest.mark.parametrize("depth", [1, 2, 7, 100])
def test_advance_equals_the_rule(depth):
    rng = random.Random(depth)
    for _ in range(60):
        rows = forked(rng, "c", 300, rng.choice([3, 30, 250]))
        if rng.random() < 0.5:
            rng.shuffle(rows)
        rows = [("c", i, *r[2:]) for i, r in enumerate(rows)]
        number, hash_, parent = ([r[c] for r in rows] for c in (2, 3, 4))
        known = {}
        for r in rows:
            known.setdefault(r[2], set()).add(r[3])
        doubtful = [i for i, r in enumerate(rows) if known.get(r[2] - 1, set()) - {r[4]}]
        forks, held = reorg.advance({}, number, hash_, parent, doubtful, depth)
        assert [("c", *f) for f in forks] == plain(rows, depth)
        assert len(held) <= depth - 1


@pytest.mark.parametrize("segments,depth", [(1, 100), (13, 100), (40, 20)])
def test_segments_equal_the_rule(spark, segments, depth):
    rng = random.Random(segments)
    rows = forked(rng, "long", 4000, 160) + forked(rng, "short", 150, 9) + forked(rng, None, 40, 5)
    rows += [("falls", i, 500 - i, f"h{500 - i}", "x") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = reorg.reorg_detect(df, max_depth=depth, segments=segments)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, depth), key=repr)
    assert len(plain(rows, depth)) > 5
    assert reorg.reorg_detect(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_equals_the_rule(spark, tmp_path):
    """State crosses batches, and numbers that a batch does not ask for stay unread."""
    rng = random.Random(21)
    rows = forked(rng, "a", 500, 40) + forked(rng, "b", 300, 12)
    inbox = str(tmp_path / "in")
    for i in range(0, 5000, 700):
        part = [r for r in rows if i <= r[1] < i + 700]
        df = spark.createDataFrame(part, SCHEMA).withColumnRenamed("arrival", "ord")
        df.coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    got = drain(live.stream_reorg(stream, depth=30), "reorg")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, 30), key=repr)


def test_a_segment_stays_small_however_few_partitions_there_are(spark, monkeypatch):
    rows = [("c", i, i, f"h{i}", f"h{i - 1}" if i % 7 else "odd") for i in range(1, 2001)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes, ran = [], reorg._run

    def watched(dealt, starts, segment, max_depth):
        sizes.extend(r["count"] for r in dealt.groupBy(*segment).count().collect())
        return ran(dealt, starts, segment, max_depth)

    monkeypatch.setattr(reorg, "_run", watched)
    monkeypatch.setattr(reorg, "SEGMENT_ROWS", 100, raising=False)
    got = reorg.reorg_detect(df)
    assert sorted(map(tuple, got.collect())) == plain(rows, 100)
    assert max(sizes) <= 300

"""Quality rules by robust multivariate outliers.

Each text yields counts (words, their characters, symbols, repeated lines, words in
repeated three-word windows), and these a vector of transformed statistics. For every
(language, source) the minimum covariance determinant (MCD) estimate describes the bulk:
the mean and covariance of the ``SUPPORT`` share of rows that lie closest under that very
mean and covariance. Concentration steps go on from several starts until the support stays
the same, ``STEPS`` at most, and the start of least determinant counts. Half of the rows
are support, so that alike junk may hold any smaller share of a group. After a reweighting
step, a text is rejected if its squared Mahalanobis distance exceeds ``CUTOFF``. Texts that fail the base rule are rejected in any case and take no part in
the estimates.

A concentration step is one aggregation: rows fall into narrow bins of their distance,
each bin of a group keeps its count, sums and sums of products, and the bins nearest to
the centre that hold the support are added up. So a step shuffles at most ``BINS`` rows
for a group and task, also for a source that owns a third of all rows. Bins are cut
exactly at their edges, which makes the support differ from its share by one bin.

A group with fewer than ``MIN_ROWS`` rows joins the rest of its language, and a rest that
is still smaller joins the rest of all. ``FLOOR`` bounds the standard deviations from
below, so that statistics that hardly vary do not reject by tiny differences.

Null texts count as empty; null languages and sources are groups named by the empty
text. An empty text has zero counts and fails the base rule. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.llm.common import chunks, text_bytes
from tapeline.session import materialize

SUPPORT = 0.5
STEPS = 40
#: Logarithms of determinants that differ less are equal (the support ends at a bin's edge);
#: then the first start counts.
TIE = 0.25
MIN_ROWS = 60
#: Squared distance beyond which a text is rejected.
CUTOFF = 60.0
#: Share of a chi-square distribution that the reweighting step keeps (0.975, 5 degrees).
REWEIGHT = 12.833
#: Bins of the logarithm of the squared distance, and its range.
BINS, LOW, HIGH = 512, -12.0, 28.0
SYMBOLS = b"#*$%&|<>"
FEATURES = ("f1", "f2", "f3", "f4", "f5")
FLOOR = (0.25, 0.06, 0.30, 0.35, 0.35)
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: The covariance of the central share of a normal distribution, times this, is its own:
#: SUPPORT / P(chi2 with p + 2 degrees <= the SUPPORT quantile of chi2 with p), p = 5.
CONSISTENT = 1.912


def repeated_words(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text the words that lie in a three-word window it holds twice or more."""
    out = np.zeros(len(ends) - 1, np.int64)
    n = len(ids)
    if n < 3:
        return out
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    # number the pairs, then the triples, then the triples within a text: exact
    _, pair = np.unique(ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    _, triple = np.unique(pair[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True)
    inside = owner[:-2] == owner[2:]
    place = np.flatnonzero(inside)
    key = owner[place] * (int(triple.max()) + 1) + triple[place]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = place[order[twice]]
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[hit + j] = True
    np.add.at(out, owner[covered], 1)
    return out


def statistics(whole: bytes, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of texts laid end to end."""
    rows = len(offsets) - 1
    raw = np.frombuffer(whole, np.uint8)
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    point = (raw & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[offsets[1:]] - total[offsets[:-1]]

    number: dict[bytes, int] = {}
    words: list[bytes] = []
    counts, dup_lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    ends = offsets.tolist()
    for i in range(rows):
        text = whole[ends[i] : ends[i + 1]]
        own = text.split()
        counts[i] = len(own)
        words.extend(own)
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            dup_lines[i] = len(lines) - len(set(lines))
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    edges = np.concatenate(([0], np.cumsum(counts)))
    return {
        "n_words": counts,
        "word_chars": per_row(point & ~blank),
        "n_symbols": per_row(symbol[raw]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated_words(ids, edges),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_statistics(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    src = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = statistics(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(found[c]) for c in COUNTS)],
                names=["doc_id", "lang", "source", *COUNTS],
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(
        run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    )


def base_failed() -> Column:
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    return (n < 50) | (100 * repeats > 50 * n)


def features() -> dict[str, Column]:
    """Transformed statistics: length, word length, symbols, repeated lines and windows."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "f1": F.log1p(n),
        "f2": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "f3": F.sqrt(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f4": F.sqrt(100 * F.col("n_dup_lines") / n),
        "f5": F.sqrt(10 * F.col("n_repeat_words") / n),
    }


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with a group: (lang, source), the rest of a language, or the rest of all."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = materialize(sizes, "sizes")
    small = sizes.where(F.col("n") < MIN_ROWS)
    rest = small.groupBy("lang").agg(F.sum("n").alias("rest")).withColumnRenamed("lang", "rest_lang")
    place = sizes.join(rest, F.col("lang") == F.col("rest_lang"), "left").select(
        F.col("lang").alias("glang"),
        F.col("source").alias("gsource"),
        F.when(F.col("n") >= MIN_ROWS, F.to_json(F.array("lang", "source")))
        .when(F.col("rest") >= MIN_ROWS, F.to_json(F.array("lang")))
        .otherwise("[]")
        .alias("grp"),
    )
    place = materialize(place, "groups")
    return rows.join(place, (F.col("lang") == F.col("glang")) & (F.col("source") == F.col("gsource")))


def _centre_schema() -> str:
    return "g string, start int, c_mean array<double>, c_inverse array<double>, c_level double"


def _distance(mean: str = "c_mean", inverse: str = "c_inverse") -> Column:
    """Squared Mahalanobis distance of a row's features; the inverse is a full matrix."""
    gaps = [F.col(f) - F.element_at(mean, i + 1) for i, f in enumerate(FEATURES)]
    terms = [
        F.element_at(inverse, i * P + j + 1) * gaps[i] * gaps[j] * (1.0 if i == j else 2.0) for i, j in PAIRS
    ]
    return sum(terms[1:], terms[0])


def centre_of(
    n: float, sums: list[float], products: list[float], widen: float
) -> tuple[list[float], list[float], float]:
    """Mean, inverse covariance and its log determinant from moments, deviations above the floor."""
    mean = np.array(sums) / n
    cov = np.zeros((P, P))
    for (i, j), s in zip(PAIRS, products):
        cov[i, j] = cov[j, i] = s / n - mean[i] * mean[j]
    cov = cov * widen + np.diag(np.square(FLOOR))
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _solve(moments: DataFrame, widen: float) -> DataFrame:
    """Centres from one row of moments for each group and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [centre_of(r["n"], r["sums"], r["products"], widen) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grp"),
                    batch.column("start"),
                    pa.array([m for m, _, _ in rows], pa.list_(pa.float64())),
                    pa.array([v for _, v, _ in rows], pa.list_(pa.float64())),
                    pa.array([d for _, _, d in rows], pa.float64()),
                ],
                names=["g", "start", "c_mean", "c_inverse", "c_level"],
            )

    packed = moments.select(
        "grp",
        "start",
        F.col("n").cast("double").alias("n"),
        F.array(*[f"s{i}" for i in range(P)]).alias("sums"),
        F.array(*[f"p{i}{j}" for i, j in PAIRS]).alias("products"),
    )
    return packed.mapInArrow(run, _centre_schema())


def _moments() -> list[Column]:
    out = [F.count("*").alias("n")]
    out += [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    out += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in PAIRS]
    return out


def _starts(rows: DataFrame) -> DataFrame:
    """First centres: medians with spreads from the quartiles, and the shortest halves of the
    coordinates, which junk below a half cannot move far, about their middles and the medians.
    No start may be one that junk has widened: alike junk makes the lesser determinant then."""
    shares = [i / 40 for i in range(1, 40)]
    found = rows.groupBy("grp").agg(
        *[F.percentile_approx(f, shares, 2000).alias(f"q{i}") for i, f in enumerate(FEATURES)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = np.array([r[f"q{i}"] for i in range(P)])
                median, quartiles = at[:, 19], (at[:, 29] - at[:, 9]) / 1.349
                halves = at[:, 20:] - at[:, :19]
                low, each = halves.argmin(axis=1), np.arange(P)
                short = halves[each, low]
                middle = at[each, low] + short / 2
                # quartiles that reach into junk would let it into the support
                quartiles = np.where(quartiles <= 1.5 * short / 1.349, quartiles, short / 1.349)
                for start, (mean, spread) in enumerate(
                    ((median, quartiles), (middle, short / 1.349), (median, short / 1.349))
                ):
                    inverse = np.diag(1 / (np.square(spread) + np.square(FLOOR)))
                    out.append((r["grp"], start, mean.tolist(), inverse.ravel().tolist(), 0.0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.string()),
                    pa.array([o[1] for o in out], pa.int32()),
                    pa.array([o[2] for o in out], pa.list_(pa.float64())),
                    pa.array([o[3] for o in out], pa.list_(pa.float64())),
                    pa.array([o[4] for o in out], pa.float64()),
                ],
                names=["g", "start", "c_mean", "c_inverse", "c_level"],
            )

    return materialize(found.mapInArrow(run, _centre_schema()), "centres")


def _support_centres(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """One concentration step: the centres of the rows nearest to the given ones."""
    wide = (HIGH - LOW) / BINS
    sums = ["n", *(f"s{i}" for i in range(P)), *(f"p{i}{j}" for i, j in PAIRS)]
    near = rows.join(centres, F.col("grp") == F.col("g"))
    level = F.log(F.greatest(_distance(), F.lit(math.exp(LOW))))
    bin_no = F.least(F.floor((level - LOW) / wide), F.lit(BINS - 1)).cast("int")
    binned = near.groupBy("grp", "start", bin_no.alias("bin")).agg(*_moments())
    up = Window.partitionBy("grp", "start").orderBy("bin")
    whole = Window.partitionBy("grp", "start")
    upto = binned.select(
        "grp",
        "start",
        F.sum("n").over(whole).alias("rows"),
        *[F.sum(c).over(up).alias(c) for c in sums],
    )
    # the first bin at which the support is reached
    enough = upto.where(F.col("n") >= F.ceil(SUPPORT * F.col("rows")))
    chosen = enough.groupBy("grp", "start").agg(F.min(F.struct(*sums)).alias("m")).select("grp", "start", "m.*")
    return _solve(chosen, CONSISTENT)


def mcd_centres(rows: DataFrame) -> DataFrame:
    """g, c_mean and c_inverse (row by row) of each group ``grp`` of feature rows."""
    moving = _starts(rows).withColumn("seen", F.array().cast("array<double>"))
    settled = None
    for step in range(STEPS):
        fresh = _support_centres(rows, moving)
        old = moving.select(F.col("g").alias("old_g"), F.col("start").alias("old_start"), "seen")
        both = fresh.join(old, (F.col("g") == F.col("old_g")) & (F.col("start") == F.col("old_start")))
        # a determinant that comes again is the same support, or a round of supports that
        # differ by a bin; sums of the same rows differ by their order only
        still = F.exists("seen", lambda x: F.abs(x - F.col("c_level")) <= 1e-9)
        seen = F.concat("seen", F.array("c_level"))
        both = both.select(*fresh.columns, seen.alias("seen"), still.alias("still"))
        both = materialize(both, "steps")
        last = step == STEPS - 1
        done = (both if last else both.where("still")).drop("still", "seen")
        settled = done if settled is None else settled.unionByName(done)
        moving = both.where("NOT still").drop("still")
        if last or moving.isEmpty():
            break
    least = Window.partitionBy("g")
    best = settled.withColumn("least", F.min("c_level").over(least)).where(F.col("c_level") <= F.col("least") + TIE)
    best = best.groupBy("g").agg(F.min(F.struct("start", "c_mean", "c_inverse", "c_level")).alias("s")).select("g", "s.*")
    centres = materialize(best, "centres")
    near = rows.join(centres, F.col("grp") == F.col("g"))
    moments = near.where(_distance() <= REWEIGHT).groupBy("grp", "start").agg(*_moments())
    final = materialize(_solve(moments, 1.0), "centres")
    # a group with no row inside keeps its last centre
    missing = centres.join(final.select(F.col("g").alias("done")), F.col("g") == F.col("done"), "left_anti")
    return materialize(final.unionByName(missing).select("g", "c_mean", "c_inverse"), "centres")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared; null if base_failed) and kept."""
    counted = materialize(count_statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    failed = counted.where(base_failed())
    rows = _grouped(counted.where(~base_failed()).withColumns(features()))
    rows = materialize(rows.drop("glang", "gsource"), "features")
    centres = mcd_centres(rows)
    judged = rows.join(centres, F.col("grp") == F.col("g"), "left")
    columns = ["doc_id", *COUNTS]
    passed = judged.select(*columns, F.lit(False).alias("base_failed"), _distance().alias("distance"))
    passed = passed.withColumn("kept", F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    rest = failed.select(
        *columns, F.lit(True).alias("base_failed"), F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return passed.unionByName(rest)


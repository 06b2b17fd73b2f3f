"""SimHash near-duplicates by shards of BK-trees.

The fingerprint of a text has bit ``i`` set if more than half of the hashes of its
three-word shingles have it. Two fingerprints link if they differ in at most ``RADIUS``
bits; a document's class is the smallest id that links reach.

Search. Among four 16-bit quarters, two fingerprints at distance two or less agree in at
least two. So each distinct fingerprint goes to six shards, one for each pair of
quarters, keyed by their value, and every link is found inside a shard. Inside a shard
the fingerprints form a BK-tree: a child hangs on its parent by the integer Hamming
distance between them, and a search of radius r around q only follows edges in
[d(q, node) - r, d(q, node) + r]. A broadcast tree of all fingerprints would have no
size bound, so a tree travels with its queries in the shuffle that forms the shards.
Shards with more than ``TREE_ROWS`` fingerprints are cut into blocks, and each pair of
blocks meets in a task of its own: memory stays bounded and no link is lost.

A task hands on a spanning forest of the links it found, never all pairs.

A text without words has fingerprint zero and is linked like any other. Null text counts
as empty. A null id is kept in the rows and never names a class unless the class has no
other id. Rows that repeat an id are separate rows of the result. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import chunks, id_text, text_bytes
from tapeline.llm.graph import connected_components
from tapeline.session import materialize

SHINGLE = 3
RADIUS = 2
#: Fingerprints of a shard that make one tree; larger shards are cut into blocks.
TREE_ROWS = 4096
#: (query, node) pairs that a search holds at a time.
FRONTIER = 400_000
#: Shingle hashes whose bits are counted at a time.
COUNTED = 100_000


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have bit 0, 1, ... 63."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(
            hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # bytes: only A-Z change, only the six ASCII spaces part
    if not words:
        return []
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [hashed(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    return [hashed(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]


WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def simhash(text: bytes) -> int:
    hashes = np.array(shingle_hashes(text), np.uint64)
    set_bits = 2 * bit_counts(hashes) > len(hashes)
    return int(WEIGHTS[set_bits].sum(dtype=np.uint64))


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and the SimHash ``fp`` (its 64 bits as a signed long) of every whole text."""
    src = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            whole, offsets = text_bytes(batch.column("text"))
            ends = offsets.tolist()
            found = [simhash(whole[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKForest:
    """One BK-tree for each shard, all built and searched together.

    ``items`` are fingerprints, ``shard`` their shard numbers (0, 1, ...). A node's
    children are the runs ``first[node] : first[node] + count[node]`` of ``child`` sorted
    by ``edge``, the distance between parent and child.
    """

    def __init__(self, items: np.ndarray, shard: np.ndarray):
        self.items = items
        n = len(items)
        shards = int(shard.max()) + 1 if n else 0
        order = np.argsort(shard, kind="stable")
        lead = np.ones(n, bool)
        lead[1:] = shard[order][1:] != shard[order][:-1]
        self.root = np.full(shards, -1, np.int64)
        self.root[shard[order][lead]] = order[lead]
        rest = order[~lead]
        at = self.root[shard[rest]]
        parents, edges, kids = [], [], []
        while len(rest):
            # each item steps down to the child at its distance; where there is none, the
            # first such item becomes that child
            d = distance(items[rest], items[at]).astype(np.int64)
            slot = at * 65 + d
            by = np.argsort(slot, kind="stable")
            new = np.ones(len(by), bool)
            new[1:] = slot[by][1:] != slot[by][:-1]
            run = np.cumsum(new) - 1
            heads = rest[by[new]]
            parents.append(at[by[new]])
            edges.append(d[by[new]])
            kids.append(heads)
            stay = ~new
            rest, at = rest[by[stay]], heads[run[stay]]
        parent = np.concatenate(parents) if parents else np.empty(0, np.int64)
        edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        kid = np.concatenate(kids) if kids else np.empty(0, np.int64)
        by = np.lexsort((edge, parent))
        self.key = parent[by] * 65 + edge[by]  # sorted
        self.child = kid[by]

    def search(
        self, queries: np.ndarray, shard: np.ndarray, radius: int = RADIUS
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, item index) at most ``radius`` apart, in bounded batches."""
        step = 20_000
        for a in range(0, len(queries), step):
            q = np.arange(a, min(a + step, len(queries)))
            stack = [(q, self.root[shard[q]])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack.append((q[half:], node[half:]))
                    q, node = q[:half], node[:half]
                d = distance(queries[q], self.items[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                if n.any():
                    q = np.repeat(q, n)
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    stack.append((q, self.child[place]))


def forest_of_links(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The smallest index of each item's class under the given links."""
    low = np.arange(n)

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = low[a], low[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(low, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = low[low]
                if (up == low).all():
                    break
                low[:] = up

    for a, b in pairs:
        settle(a, b)
    return low


def shard_links(items: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (item, smallest item of its class) within whole shards."""
    _, shard = np.unique(keys, return_inverse=True)
    size = np.bincount(shard)
    many = size[shard] > 1
    if not many.any():
        return items[:0], items[:0]
    items, shard = items[many], shard[many]
    tree = BKForest(items, shard)
    low = forest_of_links(tree.search(items, shard), len(items))
    linked = low != np.arange(len(items))
    return items[linked], items[low[linked]]


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``RADIUS`` bits.

    ``distinct`` has one column ``fp`` without repeats or nulls.
    """
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [
        F.lit((4 * i + j) << 32).bitwiseOR(F.shiftleft(quarter[i], 16)).bitwiseOR(quarter[j])
        for i in range(4)
        for j in range(i + 1, 4)
    ]
    placed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"))
    # only shards that hold two fingerprints can hold a link
    sizes = materialize(sizes.where("n > 1"), "shards")
    blocks = F.ceil(F.col("n") / TREE_ROWS).cast("int")
    sharded = placed.join(sizes, "key").select(
        "fp", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own")
    )
    # block pairs (i, j) with i <= j, as one number
    met = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda x: F.least(x, F.col("own")).cast("long") * F.col("blocks")
            + F.greatest(x, F.col("own")),
        )
    )
    met = sharded.select("fp", "key", F.explode(met).alias("pair"))
    dealt = met.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def work(until: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            fp = np.concatenate([h[0] for h in held])
            place = np.concatenate([h[1] for h in held])
            change = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            cut = len(fp) if until else (int(change[-1]) if len(change) else 0)
            if cut:
                mark = np.zeros(cut, np.int64)
                mark[change[change < cut]] = 1
                a, b = shard_links(fp[:cut], np.cumsum(mark))
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
                    )
            held = [(fp[cut:], place[cut:])] if cut < len(fp) else []
            rows = len(fp) - cut

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            place = np.stack([batch.column(c).to_numpy() for c in ("key", "pair")], axis=1)
            held.append((fp, place))
            rows += len(fp)
            if rows >= 50_000:
                yield from work(False)
        if held:
            yield from work(True)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``.

    ``component_id`` is the smallest id of the class. Only ids and fingerprints are
    written and shuffled, never texts.
    """
    prints = materialize(fingerprint_documents(docs, id_col, text_col), "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = materialize(connected_components(link_fingerprints(firsts.select("fp"))), "roots")
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    classes = materialize(
        rooted.groupBy(F.col("root").alias("class")).agg(F.min("least_id").alias("component_id")),
        "classes",
    )
    of_print = rooted.join(classes, F.col("root") == F.col("class")).select(
        F.col("fp").alias("print"), "component_id"
    )
    of_print = materialize(of_print, "components")
    return prints.join(of_print, F.col("fp") == F.col("print"), "left").select(
        "doc_id", "fp", "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: its smallest id.

    Of rows that repeat that id and the text one stays; a class whose ids are all null
    keeps one row of each text. All columns of ``docs`` stay as they are.
    """
    return keep_heads(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def keep_heads(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class in ``found`` (doc_id, fp, component_id)."""
    found = materialize(found.select("doc_id", "fp", "component_id"), "near")
    heads = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("doc_id")
        .agg(F.min("fp").alias("fp"), F.count("*").alias("n"))
    )
    heads = materialize(heads.select(F.col("doc_id").alias("head_id"), F.col("n").alias("head_n")), "heads")
    kept = docs.join(heads, docs[id_col].eqNullSafe(heads["head_id"]), "left_semi")
    repeated = heads.where("head_n > 1")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept[id_col].eqNullSafe(repeated["head_id"]), "left_semi")
    single = kept.join(repeated, kept[id_col].eqNullSafe(repeated["head_id"]), "left_anti")
    return single.unionByName(once.dropDuplicates([id_col, text_col]))

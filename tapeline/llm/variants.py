"""Spelling variants: words one edit apart, from a trie over letter-group counts.

Letters are dealt into ``GROUPS`` groups of near equal frequency, and a word's vector counts
its letters of each group. Words in a trie lie under the successive counts of their
vectors. An inserted letter adds one to one count, a deleted one takes one from one, a
replaced one may do both, so a search for the words near another goes down the trie, depth
first, with a budget of one surplus and one deficit; the words in the leaves it reaches are
verified letter by letter.

Subtrees. The trie is cut at one depth, the least at which no subtree holds more than
``SUBTREE`` words (one aggregate over the vectors says which). A word is a member of one
subtree and a query to the others that a surplus and a deficit can reach; of two subtrees
only the one with the smaller counts asks, so a pair is met once. A subtree's members and
queries meet in a task, where queries go down together in blocks of ``BLOCK`` steps: a
stack of blocks, so that memory does not grow with the number of candidates. Only pairs of
near words leave the task.

Letters beyond the ``LETTERS`` most frequent ones go to groups by code point. Counts beyond
255 count as 255, which lets more words through to the check and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import code_points, text_bytes
from tapeline.llm.runs import agreeing
from tapeline.session import materialize

GROUPS = 12
LETTERS = 4096
SUBTREE = 4_000
BLOCK = 1 << 17
#: A near word is a word's form if it is as many times as frequent.
RATIO = 5


def letter_groups(words: DataFrame) -> dict[int, int]:
    """Group of each of the most frequent letters, by code point: the lightest one so far."""
    letters = (
        words.select(F.explode(F.split("word", "")).alias("letter"))
        .where("letter <> ''")
        .groupBy("letter")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "letter")
        .limit(LETTERS)
        .collect()
    )
    weight = [0] * GROUPS
    groups = {}
    for row in letters:
        lightest = weight.index(min(weight))
        groups[ord(row["letter"])] = lightest
        weight[lightest] += row["n"]
    return groups


def vectors(column: pa.Array, groups: dict[int, int]) -> np.ndarray:
    """Letter-group counts of words, one row each."""
    whole, _ = text_bytes(column)
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = code_points(whole)
    kinds, which = np.unique(codes, return_inverse=True)
    group = np.array([groups.get(k, k % GROUPS) for k in kinds.tolist()], np.int64)
    cells = np.repeat(np.arange(len(lengths)) * GROUPS, lengths)
    if len(codes):
        cells = cells + group[which]
    counts = np.bincount(cells, minlength=len(lengths) * GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(lengths), GROUPS)


def with_vectors(words: DataFrame, groups: dict[int, int]) -> DataFrame:
    """word, n and ``vec``, the counts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = vectors(batch.column("word"), groups)
            yield batch.append_column("vec", pa.array([row.tobytes() for row in counts], pa.binary()))

    return words.select("word", "n").mapInArrow(run, "word string, n long, vec binary")


def cut_depth(vecs: DataFrame) -> int:
    """The least depth at which no subtree holds more than ``SUBTREE`` words."""
    leaves = vecs.groupBy("vec").agg(F.count("*").alias("words"))
    depths = F.explode(F.array(*[F.lit(d) for d in range(1, GROUPS + 1)])).alias("depth")
    sizes = (
        leaves.select("vec", "words", depths)
        .groupBy("depth", F.expr("substring(vec, 1, depth)").alias("path"))
        .agg(F.sum("words").alias("words"))
        .groupBy("depth")
        .agg(F.max("words").alias("most"))
        .collect()  # one row for each depth
    )
    fitting = [row["depth"] for row in sizes if row["most"] <= SUBTREE]
    return min(fitting, default=GROUPS)


def asked(vecs: DataFrame, depth: int) -> DataFrame:
    """Members and queries of subtrees: subtree, role (0 or 1), word, n, vec."""
    moves = [(plus, None) for plus in range(depth)]
    moves += [(plus, minus) for plus in range(depth) for minus in range(plus + 1, depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                own = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.uint8)
                own = own.reshape(-1, GROUPS)[:, :depth]
                rows, paths, roles = [np.arange(len(own))], [own], [np.zeros(len(own), np.int8)]
                for plus, minus in moves:
                    fits = own[:, plus] < 255
                    if minus is not None:
                        fits &= own[:, minus] > 0
                    some = np.flatnonzero(fits)
                    path = own[some].copy()
                    path[:, plus] += 1
                    if minus is not None:
                        path[:, minus] -= 1
                    rows.append(some)
                    paths.append(path)
                    roles.append(np.ones(len(some), np.int8))
                taken = batch.take(pa.array(np.concatenate(rows)))
                subtree = [p.tobytes() for p in np.concatenate(paths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(subtree, pa.binary()), pa.array(np.concatenate(roles)), *taken.columns],
                    names=["subtree", "role", "word", "n", "vec"],
                )

    return vecs.select("word", "n", "vec").mapInArrow(
        run, "subtree binary, role byte, word string, n long, vec binary"
    )


class Trie:
    """Words under the successive counts of their vectors, from level ``depth`` down."""

    def __init__(self, counts: np.ndarray, depth: int):
        """``counts`` are the vectors in ascending order, alike up to ``depth``."""
        self.depth = depth
        n, levels = counts.shape
        new = np.zeros(n, bool)
        new[:1] = True
        first = np.flatnonzero(new)  # first word of each node of the level above
        self.levels = []
        for level in range(depth, levels):
            new[1:] |= counts[1:, level] != counts[:-1, level]
            below = np.flatnonzero(new)
            edges = np.searchsorted(below, np.append(first, n))
            self.levels.append((edges[:-1], edges[1:], counts[below, level].astype(np.int64)))
            first = below
        self.leaf_from, self.leaf_to = first, np.append(first[1:], n)

    def search(self, queries: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> Iterator[tuple]:
        """Blocks of pairs (query, word) whose vectors differ by one surplus and one deficit
        at most; ``plus`` and ``minus`` say what a query's way to this subtree has spent."""
        root = np.zeros(len(queries), np.int64)
        stack = [(0, np.arange(len(queries)), root, plus, minus)]
        while stack:
            level, query, node, plus, minus = stack.pop()
            leaf = level == len(self.levels)
            start, end = (self.leaf_from, self.leaf_to) if leaf else self.levels[level][:2]
            count = end[node] - start[node]
            upto = np.cumsum(count)
            fit = int(np.searchsorted(upto, BLOCK, side="right"))
            if fit < len(query):
                fit = max(fit, 1)
                stack.append((level, query[fit:], node[fit:], plus[fit:], minus[fit:]))
                query, node, plus, minus = query[:fit], node[:fit], plus[:fit], minus[:fit]
                count, upto = count[:fit], upto[:fit]
            row = np.repeat(np.arange(fit), count)
            below = np.arange(len(row)) + np.repeat(start[node] - upto + count, count)
            if leaf:
                yield query[row], below
                continue
            more = self.levels[level][2][below] - queries[query[row], self.depth + level]
            plus, minus = plus[row] + (more > 0), minus[row] + (more < 0)
            alive = (np.abs(more) <= 1) & (plus <= 1) & (minus <= 1)
            if alive.any():
                stack.append((level + 1, query[row[alive]], below[alive], plus[alive], minus[alive]))


def one_edit(codes: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, unlike each other, differ by one letter."""
    la, lb = size[a], size[b]
    close = np.abs(la - lb) <= 1
    shorter = np.where(close, np.minimum(la, lb), 0)
    head = agreeing(codes, start[a], start[b], shorter)
    # beyond the first difference the rest must agree, less the letter of the longer word
    skip_a, skip_b = (la >= lb).astype(np.int64), (lb >= la).astype(np.int64)
    rest = np.maximum(np.where(close, la - head - skip_a, 0), 0)
    tail = agreeing(codes, start[a] + head + skip_a, start[b] + head + skip_b, rest)
    return close & (tail == rest)


def near_pairs(vecs: DataFrame) -> DataFrame:
    """word, near and near_n for every two words one edit apart, in both directions."""
    depth = cut_depth(vecs)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role = table.column("role").to_numpy()
        vec = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.uint8).reshape(-1, GROUPS)
        member = np.flatnonzero(role == 0)
        member = member[np.lexsort(vec[member].T[::-1])]
        found_a, found_b = [], []
        if len(member):
            trie = Trie(vec[member], depth)
            words = table.column("word").chunk(0)
            whole, _ = text_bytes(words)
            codes = code_points(whole)
            size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            query = np.concatenate((member, np.flatnonzero(role == 1)))
            queries = vec[query].astype(np.int64)
            spent = vec[member[0], :depth].astype(np.int64) - queries[:, :depth]
            for q, m in trie.search(queries, (spent > 0).sum(axis=1), (spent < 0).sum(axis=1)):
                # of two members the earlier one asks
                other = (q >= len(member)) | (q < m)
                a, b = query[q[other]], member[m[other]]
                near = one_edit(codes, start, size, a, b)
                found_a.append(a[near])
                found_b.append(b[near])
        a = np.concatenate([*found_a, np.zeros(0, np.int64)])
        b = np.concatenate([*found_b, np.zeros(0, np.int64)])
        both, other = pa.array(np.concatenate((a, b))), pa.array(np.concatenate((b, a)))
        return pa.table(
            {
                "word": table.column("word").take(both),
                "near": table.column("word").take(other),
                "near_n": table.column("n").take(other),
            }
        )

    return (
        asked(vecs, depth)
        .groupBy("subtree")
        .applyInArrow(run, "word string, near string, near_n long")
    )


def followed(links: DataFrame) -> DataFrame:
    """word and root: the end of the chain of links (word, root), by doubling.

    A form is more frequent than its word, so chains end; each round halves them.
    """
    links = materialize(links, "forms")
    while True:
        ahead = links.select(F.col("word").alias("via"), F.col("root").alias("further"))
        step = links.join(ahead, F.col("root") == F.col("via"), "left")
        moved = materialize(
            step.select(
                "word",
                F.coalesce("further", "root").alias("root"),
                F.col("further").isNotNull().alias("moved"),
            ),
            "forms",
        )
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table of distinct words and counts n.

    ``form`` is the most frequent near word (the smallest in code-point order among equals)
    if it is at least ``ratio`` times as frequent, else null; ``root`` is where forms lead.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    vecs = materialize(with_vectors(words, letter_groups(words)), "vectors")
    best = near_pairs(vecs).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"),
    )
    frequent = -F.col("best.n") >= ratio * F.col("n")
    found = materialize(
        words.join(best, "word", "left").select(
            "word",
            F.when(frequent, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, -F.col("best.n")).alias("form_n"),
        ),
        "near",
    )
    roots = followed(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def frequent_words(
    occurrences: DataFrame, word: Column, min_length: int = 6, min_count: int = 5
) -> DataFrame:
    """word and n: the words of at least ``min_length`` letters that occur often enough."""
    return (
        occurrences.select(word.alias("word"))
        .where(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )

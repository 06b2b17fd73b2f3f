"""Boilerplate lines, told by the number of distinct sites they spread over.

Lines are keyed by two hashes. For each key a HyperLogLog sketch of its sites is built in
every task and merged by aggregation. A sketch well above ``MIN_SITES`` settles a line as
boilerplate, one well below settles it as the site's own; lines whose estimate comes
near the threshold get an exact count of their distinct sites. So the outcome equals an
exact count for all lines, while nearly all lines only pass a small sketch.

A line is boilerplate if documents of at least ``MIN_SITES`` sites hold it, copies of one
text among them: every document counts with its own site. Such lines of ``MIN_CHARS`` code
points or more go from every document, however much of it they are.

Lines are what ``\\n`` parts; they are compared as they are. Null sites count as one site
named by the empty text; null and empty texts stay as they are. Rows that repeat an id
are documents of their own. An empty table gives an empty result. Other columns stay,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize

MIN_SITES = 8
MIN_CHARS = 12
#: log2 of the sketch's size; its relative standard error is 1.04 / sqrt(2^10).
SKETCH_BITS = 10
#: Estimates within this share of the threshold are counted exactly (over six errors).
NEAR = 0.25


def _key(line: Column) -> Column:
    """Two hashes of a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _keys(text: Column, min_chars: int) -> Column:
    """Keys of the lines that are long enough."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(F.filter(lines, lambda x: F.length(x) >= min_chars), _key)


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (h, g) of lines on at least ``min_sites`` distinct sites, from (h, g, site)."""
    sketches = lines.groupBy("h", "g").agg(
        F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch")
    )
    sized = sketches.select("h", "g", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    sized = materialize(sized.where(F.col("sites") >= low), "sites")
    sure = sized.where(F.col("sites") > high).select("h", "g")
    near = sized.where(F.col("sites") <= high).select("h", "g")
    exact = (
        lines.join(near, ["h", "g"], "left_semi")
        .distinct()
        .groupBy("h", "g")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("h", "g")
    )
    return sure.union(exact)


def drop_boilerplate(
    docs: DataFrame,
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
    count_col: str | None = None,
) -> DataFrame:
    """``docs`` without boilerplate lines; ``count_col`` names a column of their number."""
    text, site = docs[text_col], docs[site_col]
    # tasks put a site's copies together before the shuffle, so many copies are no hot key
    texts = (
        docs.select(
            _text_key(text).alias("text_key"),
            F.coalesce(site.cast("string"), F.lit("")).alias("site"),
            F.array_distinct(_keys(text, min_chars)).alias("lines"),
        )
        .where(F.size("lines") > 0)
        .groupBy("text_key", "site")
        .agg(F.first("lines").alias("lines"))
    )
    texts = materialize(texts, "texts")
    lines = texts.select("text_key", "site", F.explode("lines").alias("line"))
    lines = lines.select("text_key", "site", "line", "line.h", "line.g")
    spread = materialize(spread_lines(lines.select("site", "h", "g"), min_sites), "boilerplate")

    # the boilerplate lines of one text, which its length bounds
    hit = lines.join(spread, ["h", "g"], "left_semi").select("text_key", "line")
    lists = hit.groupBy("text_key").agg(F.collect_set("line").alias("lines"))
    lists = materialize(
        lists.select(F.col("text_key").alias("__line_key"), F.col("lines").alias("__line_set")),
        "carriers",
    )
    joined = docs.join(lists, _text_key(text) == lists["__line_key"], "left")
    rows = F.split(text, "\n", -1)
    gone = lists["__line_set"]
    kept = F.filter(
        rows, lambda x: (F.length(x) < min_chars) | ~F.array_contains(gone, _key(x))
    )
    fresh = F.when(gone.isNotNull(), F.array_join(kept, "\n")).otherwise(text)
    columns = [fresh.alias(c) if c == text_col else docs[c] for c in docs.columns]
    if count_col:
        dropped = F.when(gone.isNotNull(), F.size(rows) - F.size(kept)).otherwise(0)
        columns.append(dropped.cast("long").alias(count_col))
    return joined.select(*columns)

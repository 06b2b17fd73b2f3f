"""Documents with everything that may go wrong in a table."""

from pyspark.sql import types as T

LONG = "alpha beta gamma delta " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nAnd runs away from it all, far away."),
    (2, None),
    (3, ""),
    (4, "same text in two rows, with some more words to it"),
    (4, "same text in two rows, with some more words to it"),
    (5, "same text in two rows, with some more words to it"),
    (None, "a row without an id"),
    (6, LONG),
    (7, "  \t\n  \r\n"),
    (8, "Été à la plage　日本語 テスト ★ 12345 don't they'll 'tis"),
    (9, "x"),
]
# further columns, named like the ones that operators make inside
EXTRA = ["fp", "key", "word", "text_key", "score", "part", "tail", "line", "grp", "label", "__pii_key"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("lang", "source")]
    + [T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA]
)


def odd_documents(spark, rows=ROWS):
    full = [
        (i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", len(t or ""))
        + tuple("clash" for _ in EXTRA)
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")

"""Registered queries of the document operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import (
    bpe,
    gru,
    html_text,
    linededup,
    packing,
    pii,
    quality,
    runs,
    shards,
    simhash,
    syncmers,
    toxicity,
    variants,
)
from tapeline.llm.common import crc_mod, read_table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PACK_TOKENIZER = "byte_bpe_50k.json"


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole and edited texts, and their likenesses."""
    return syncmers.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the classes that links of two bits or fewer make."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = toxicity.train_labels(read_table(spark, sf_dir, "labels"))
    return toxicity.fit(read_table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all texts by nearest labelled examples."""
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "evidence"
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of whole texts and the bytes they decode to, as digests."""
    path = public_tokenizers.path(BPE_RANKS)
    coded = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and how many mentions gave way."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, count_col="n_replaced")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines, and how many lines went."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.drop_boilerplate(docs, count_col="n_dropped").select("doc_id", "text", "n_dropped")


OP6_SQL = f"""
WITH docs AS (SELECT doc_id, text, coalesce(source, '') AS site, md5(text) AS k FROM documents),
texts AS (SELECT k, any_value(text) AS text FROM docs GROUP BY k),
lines AS (SELECT k, site, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT k, site, text FROM docs)),
spread AS (
  SELECT line FROM lines WHERE length(line) >= {linededup.MIN_CHARS}
  GROUP BY line HAVING count(DISTINCT site) >= {linededup.MIN_SITES}
),
kept AS (
  SELECT k, list_filter(string_split(text, chr(10)),
    lambda x: length(x) < {linededup.MIN_CHARS} OR NOT list_contains(gone, x)) AS kept
  FROM texts JOIN (
    SELECT k, list(DISTINCT line) AS gone FROM lines JOIN spread USING (line) GROUP BY k
  ) USING (k)
)
SELECT doc_id, CASE WHEN s.k IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(CASE WHEN s.k IS NULL THEN 0 ELSE len(string_split(text, chr(10))) - len(kept) END AS BIGINT) AS n_dropped
FROM docs d LEFT JOIN kept s ON d.k = s.k
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole texts, the base rule and the verdict of the robust estimates."""
    found = quality.judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op8_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of whole texts under counts and under the gated recurrent model."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    vocabulary, counts, model = gru.fit(docs.where(~held_out))
    scored = gru.score(docs, vocabulary, counts, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = html_text.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of at most 2048."""
    path = public_tokenizers.path(PACK_TOKENIZER)
    return packing.pack(read_table(spark, sf_dir, "documents"), path)


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes by a k-d tree over language, source and length."""
    placed = shards.shard_by_metadata(read_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: ASCII letters and those of Latin-1, in runs.
LETTER_RUN = "[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in as many, by a hash of its document and itself, loses a letter.
MISSPELT = 199


def misspelt_runs(docs: DataFrame) -> DataFrame:
    """Column ``word``: every run of letters in lower case, some less one letter.

    Runs under six letters are left out, as they can only get shorter.
    """
    runs_ = F.explode(F.regexp_extract_all("text", F.lit(LETTER_RUN), 0)).alias("run")
    lowered = (
        docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs_)
        .where(F.length("run") >= 6)
        .select("id", F.translate("run", UPPER, LOWER).alias("run"))
    )
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.left("run", at), F.substr("run", at + 2))
    return lowered.select("run", h.alias("h")).select(
        F.when(F.col("h") % MISSPELT == 0, shorter).otherwise(F.col("run")).alias("word")
    )


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with the more frequent ones that they are spelling variants of."""
    found = misspelt_runs(read_table(spark, sf_dir, "documents"))
    return variants.variant_groups(variants.frequent_words(found, F.col("word")))


WORD = "[^\\x20\\x09-\\x0D]+"


def repeated_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by a hash of its id repeats itself.

    From a word on, chosen by the hash, such a document's words go on with a period.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, n, a, p = F.floor(F.col("h") / 10), F.col("n"), F.col("a"), F.col("p")
    drawn = (
        docs.select("doc_id", "text", h.alias("h"))
        .withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)))
        .withColumn("n", F.when(F.size("words") > 0, F.size("words").cast("long")))
        .withColumn("a", g % n)
        .withColumn("p", 1 + F.floor((n - a) / (3 + g % 8)))
    )
    places = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
    )
    changed = F.when(n.isNotNull(), F.array_join(places, " ")).otherwise(F.col("text"))
    return drawn.select("doc_id", changed.alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in whole texts, the longest one, and digests of the rest."""
    found = runs.find_runs(repeated_texts(read_table(spark, sf_dir, "documents")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.col3")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_syncmers": op1_syncmers,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_gru": op8_gru,
    "op9_html": op9_html,
    "op10_packing": op10_packing,
    "op11_kd_shards": op11_kd_shards,
    "op12_variants": op12_variants,
    "op13_runs": op13_runs,
}
ORACLES = {"op6_line_dedup": OP6_SQL.strip()}

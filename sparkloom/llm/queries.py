"""Queries p5 and p7-p10 over the studio's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import encodings, mixing, packing, pii, secrets, tokens
from sparkloom.session import table, written

# --- 5: personal information -----------------------------------------------------------------------


def call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "llm_calls")
    field = lambda f: c.select(F.col("call_id").alias("row_key"), F.lit(f).alias("field_name"), F.col(f).alias("text"))
    return field("prompt").unionByName(field("response"))


def _parts(spark: SparkSession, sf_dir: str, texts: DataFrame) -> dict[str, str]:
    return pii.name_parts(texts, table(spark, sf_dir, "name_lexicon"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = call_texts(spark, sf_dir)
    found = pii.find_pii(texts, _parts(spark, sf_dir, texts))
    return found.select(F.col("row_key").alias("call_id"), "field_name", "pii_kind", "found_text").distinct()


def p5_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = call_texts(spark, sf_dir)
    parts = _parts(spark, sf_dir, texts)
    return pii.found_ways(pii.find_pii(texts, parts), parts, table(spark, sf_dir, "name_lexicon"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = call_texts(spark, sf_dir)
    return pii.redact_pii(texts, _parts(spark, sf_dir, texts)).withColumnRenamed("row_key", "call_id")


# --- 7: credentials ----------------------------------------------------------------------------------


def _coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "snippets").select(F.col("snippet_id").alias("row_key"), F.col("code").alias("text"))
    c = table(spark, sf_dir, "llm_calls").select(F.col("call_id").alias("row_key"), F.col("prompt").alias("text"))
    return s, c


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _coded(spark, sf_dir)
    return s.withColumn("source_table", F.lit("snippets")).unionByName(c.withColumn("source_table", F.lit("llm_calls")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_both(spark, sf_dir)).select("source_table", "row_key", "line_no").distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _coded(spark, sf_dir)
    both = secrets.redact_secrets(s).withColumn("source_table", F.lit("snippets")).unionByName(secrets.redact_secrets(c).withColumn("source_table", F.lit("llm_calls")))
    return both.select("source_table", "row_key", "redacted", "n_found", F.array_join("kinds", ",").alias("kinds"))


def p7_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.posting_lists(secrets.trigram_index(_both(spark, sf_dir))).where("n_chunks > 0")


def p7_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.chunk_shares(written(secrets.trigram_index(_both(spark, sf_dir)), "secret-index"))


# --- 8: filling containers -------------------------------------------------------------------------------


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_key"), "text")
    return written(tokens.token_sizes(d), "tokens")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("row_key", "doc_id")


def p8_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.filling(_packed(spark, sf_dir))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    return packing.kept(packing.pack(sizes, table(spark, sf_dir, "pack_sizes")), sizes)


P8_KEPT_SQL = "SELECT pack_name, (SELECT count(*) FROM documents) AS n_texts, true AS within, true AS whole, true AS unsplit, true AS filled FROM pack_sizes"

# --- 9: mixing sources -----------------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_key"), "source", F.md5("text").alias("text_key"), "text")
    sized = written(tokens.token_sizes(d, keep=("source", "text_key")), "tokens")
    return mixing.mix(sized, table(spark, sf_dir, "mix_targets"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).withColumnRenamed("row_key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return mixing.kept(s)


P9_KEPT_SQL = """WITH held AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE text <> '' AND source IS NOT NULL), t AS (SELECT mix_name, lower(trim(source)) AS source, target_share, lower(trim(source)) IN (SELECT source FROM held) AS has FROM mix_targets)
SELECT mix_name, source, has AS has_documents, round(CASE WHEN has THEN target_share / sum(target_share) FILTER (WHERE has) OVER (PARTITION BY mix_name) ELSE 0 END, 6) AS wanted_share, true AS near, true AS capped FROM t"""

# --- 10: wrong character encoding -----------------------------------------------------------------------


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_key"), "text")
    return encodings.repair_texts(d).withColumnRenamed("row_key", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).where("state <> 'clean'").select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).where("state <> 'clean'")


def p10_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged texts by state and the encodings that restored them; none for characters that are lost."""
    return _repaired(spark, sf_dir).where("state <> 'clean'").groupBy("state", "codecs").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "p8_packed": (p8_packed, None),
    "p8_filling": (p8_filling, None),
    "p8_kept": (p8_kept, P8_KEPT_SQL),
    "p9_mixed": (p9_mixed, None),
    "p9_kept": (p9_kept, P9_KEPT_SQL),
    "p9_shares": (p9_shares, None),
    "p10_found": (p10_found, None),
    "p10_restored": (p10_restored, None),
    "p10_ways": (p10_ways, None),
    "p5_found": (p5_found, None),
    "p5_redacted": (p5_redacted, None),
    "p5_ways": (p5_ways, None),
    "p7_found": (p7_found, None),
    "p7_redacted": (p7_redacted, None),
    "p7_index": (p7_index, None),
    "p7_candidates": (p7_candidates, None),
}

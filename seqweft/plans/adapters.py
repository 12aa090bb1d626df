"""Views of the driver's tables as this package's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.functions import text as X
from seqweft.session import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sequences: letters of the text, upper case; the header has the first word and the language."""
    header = F.concat(F.lit("DOC_"), F.col("doc_id"), F.lit(" "), F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(" ["), F.col("lang"), F.lit("]"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("assembly_id"), F.concat(F.lit("DOC_"), F.col("doc_id")).alias("sequence_id"), header.alias("raw_header"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence")
    )
    return rows.withColumn("sequence_length", F.length("sequence").cast("bigint"))


def full_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1"""
    return corpus(spark, sf_dir).select(
        "assembly_id", "sequence_id", X.ambiguous_residues(F.col("sequence")).alias("ambiguous_residues"), X.functional_annotation(F.col("raw_header")).alias("functional_annotations"), "raw_header", "sequence_length", "sequence"
    )


def crawl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as crawl rows: key user_id, position event_id; purchases and sign-ups are done, errors failed, others pending."""
    status = F.when(F.col("event_type").isin("purchase", "signup"), "done").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_url"), F.col("event_id").alias("line"), status.alias("status"), F.round("value", 2).alias("value"))


CORPUS_SQL = """
WITH corpus AS (SELECT *, length(sequence) AS sequence_length FROM (SELECT source AS assembly_id, 'DOC_' || doc_id AS sequence_id,
  'DOC_' || doc_id || ' ' || regexp_extract(text, '[A-Za-z]+') || ' [' || lang || ']' AS raw_header,
  upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents))
"""

STATE_SQL = """
WITH state AS (SELECT user_id AS source_url, event_id AS line, round(value, 2) AS value,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'done' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status FROM events)
"""

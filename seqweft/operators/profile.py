"""Profiles of a corpus. Survey IDs in brackets. Aggregates go before windows and sorts, so those see few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.functions.text import CANONICAL

THRESHOLDS = (128, 256, 512, 1024)  # fixed values: the lengths of interest


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 [NUM-01]."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def null_profile(df: DataFrame) -> DataFrame:
    """T11: a row for each column, most nulls first, then by name; one pass [AG-02, PRJ-07, SRT-01]."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, dtype string, null_count bigint, non_null_count bigint, null_fraction double")
    sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("bigint")), F.lit(0)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"c{i}").alias("null_count")) for i, (c, t) in enumerate(df.dtypes)])
    long = sums.select("n", F.inline(rows))
    return long.select("column", "dtype", "null_count", (F.col("n") - F.col("null_count")).alias("non_null_count"), fraction(F.col("null_count"), F.col("n")).alias("null_fraction")).orderBy(F.desc("null_count"), "column")


def length_histogram(corpus: DataFrame, most: int | None = None) -> DataFrame:
    """T12 [AG-03, SRT-02, FLT-05]"""
    rows = corpus if most is None else corpus.where(F.col("sequence_length") <= most)
    return rows.groupBy("sequence_length").agg(F.count("*").alias("count")).orderBy("sequence_length")


def length_thresholds(corpus: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """threshold, n_longer, fraction_longer [AG-17, FLT-14]"""
    counts = corpus.agg(F.count("*").alias("n"), *[F.count_if(F.col("sequence_length") > t).alias(f"t{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"t{t}").alias("n_longer")) for t in thresholds])
    return counts.select("n", F.inline(rows)).select("threshold", "n_longer", fraction(F.col("n_longer"), F.col("n")).alias("fraction_longer"))


def length_cdf(corpus: DataFrame) -> DataFrame:
    """sequence_length, count, cumulative_count, cumulative_fraction [WIN-02]; the window runs over distinct lengths."""
    upto = Window.orderBy("sequence_length").rowsBetween(Window.unboundedPreceding, 0)
    hist = length_histogram(corpus)
    summed = hist.withColumn("cumulative_count", F.sum("count").over(upto))
    return summed.withColumn("cumulative_fraction", fraction(F.col("cumulative_count"), F.sum("count").over(Window.partitionBy())))


def length_summary(corpus: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of the lengths, exact, from their histogram [AG-30]."""
    hist = corpus.groupBy("sequence_length").agg(F.count("*").alias("n"))
    at = hist.agg(*[F.percentile("sequence_length", F.lit(p), F.col("n")).alias(name) for name, p in (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))])
    return at.select(*[F.col(c).cast("double").alias(c) for c in at.columns])


def totals(corpus: DataFrame) -> DataFrame:
    """[AG-01, AG-16]"""
    return corpus.agg(F.count_distinct("assembly_id").alias("n_assemblies"), F.count("*").alias("n_sequences"), F.coalesce(F.sum("sequence_length"), F.lit(0)).alias("n_residues"))


def residue_frequency(corpus: DataFrame) -> DataFrame:
    """residue, n, fraction, canonical [AG-18]: one pass over the characters, counted in each task before the shuffle."""
    every = corpus.select(F.explode(F.split("sequence", "")).alias("residue")).where("residue <> ''").groupBy("residue").agg(F.count("*").alias("n"))
    return every.select("residue", "n", fraction(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("fraction"), F.col("residue").isin(*CANONICAL).alias("canonical"))


def ambiguous_summary(corpus: DataFrame) -> DataFrame:
    """n_ambiguous residues and n_affected sequences, with fractions [AG-19]"""
    n = F.length(F.translate("sequence", CANONICAL, "")).cast("bigint")
    s = corpus.select(n.alias("a"), F.length("sequence").cast("bigint").alias("l")).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_ambiguous"), F.count_if(F.col("a") > 0).alias("n_affected"), F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.count("*").alias("n"))
    return s.select("n_ambiguous", fraction(F.col("n_ambiguous"), F.col("l")).alias("residue_fraction"), "n_affected", fraction(F.col("n_affected"), F.col("n")).alias("sequence_fraction"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """[AG-10, AG-27]"""
    return issues.groupBy("issue_type", "file_path").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, key: str) -> DataFrame:
    """n_rows, n_distinct and n_groups of key, nulls apart [AG-04..06]"""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_distinct"), F.max(F.col(key).isNull().cast("bigint")).alias("has_null"))


def sample_rows(df: DataFrame, n: int = 2, seed: int = 0) -> DataFrame:
    """n rows at random [LIM-05]; without a shuffle of the whole: a heap in each task."""
    return df.orderBy(F.rand(seed)).limit(n)

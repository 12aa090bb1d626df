"""Exact duplicates of sequences and latest-wins rows. Survey IDs in brackets.

Groups are formed on a SHA-256 computed where the sequence is read, so shuffles carry no sequences, but for candidates(), which
returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.operators.profile import fraction


def _digest(c: str = "sequence") -> Column:
    return F.sha2(F.col(c).cast("binary"), 256)


def duplicate_summary(corpus: DataFrame, view: str = "raw") -> DataFrame:
    """duplicate_summary rows for overall, within_assembly and across_assemblies [AG-20]; overall = within + across."""
    pairs = corpus.groupBy("assembly_id", _digest().alias("d")).agg(F.count("*").alias("n"))
    per = pairs.groupBy("d").agg(F.sum("n").alias("n"), F.count("*").alias("assemblies"), F.count_if(F.col("n") > 1).alias("inner_groups"))
    s = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct"),
        F.coalesce(F.sum("assemblies"), F.lit(0)).alias("pairs"),
        F.count_if(F.col("n") > 1).alias("g_all"),
        F.coalesce(F.sum("inner_groups"), F.lit(0)).alias("g_in"),
        F.count_if(F.col("assemblies") > 1).alias("g_across"),
    )
    row = lambda scope, groups, count: F.struct(F.lit(view).alias("view_name"), F.lit(scope).alias("duplicate_scope"), F.col(groups).alias("duplicate_group_count"), count.alias("duplicate_sequence_count"), fraction(count, F.col("rows")).alias("duplicate_rate"))
    c = F.col
    return s.select(F.inline(F.array(row("overall", "g_all", c("rows") - c("distinct")), row("within_assembly", "g_in", c("rows") - c("pairs")), row("across_assemblies", "g_across", c("pairs") - c("distinct")))))


def candidates(corpus: DataFrame) -> DataFrame:
    """One row for each sequence, of the smallest (assembly_id, sequence_id) [AG-21, SNK-18]."""
    per = corpus.groupBy("sequence").agg(F.min(F.struct("assembly_id", "sequence_id")).alias("k"), F.count("*").alias("n_copies"))
    return per.select("k.assembly_id", "k.sequence_id", "sequence", "n_copies")


def flag_duplicates(corpus: DataFrame) -> DataFrame:
    """assembly_id, sequence_id, copies and is_duplicate of each row [WIN-03]: counts joined back, which a hot sequence does not stall."""
    keyed = corpus.select("assembly_id", "sequence_id", _digest().alias("d"))
    counts = keyed.groupBy("d").agg(F.count("*").alias("copies"))
    return keyed.join(counts, "d").select("assembly_id", "sequence_id", "copies", (F.col("copies") > 1).alias("is_duplicate"))


def provenance(corpus: DataFrame) -> DataFrame:
    """Each raw row with the (assembly_id, sequence_id) that stands for it in candidates() [JN-05]."""
    keyed = corpus.select("assembly_id", "sequence_id", _digest().alias("d"))
    kept = keyed.groupBy("d").agg(F.min(F.struct("assembly_id", "sequence_id")).alias("k"))
    return keyed.join(kept, "d").select("assembly_id", "sequence_id", F.col("k.assembly_id").alias("kept_assembly_id"), F.col("k.sequence_id").alias("kept_sequence_id"))


def latest_done(rows: DataFrame, key: str, order: str, status: str = "status", dedupe: bool = True) -> DataFrame:
    """Rows with status done; the last in order for each key, or all [AG-08, AG-09, WIN-01, FLT-01, FLT-13].

    max_by aggregates before the shuffle, where a window would sort every row of a key.
    """
    done = rows.where((F.col(status) == "done") & F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    if not dedupe:
        return done
    return done.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def ranked(rows: DataFrame, order: list[str], position: int) -> DataFrame:
    """The row at a position, from 0, of a stated order [PRJ-09]: the first rows only are numbered."""
    first = rows.orderBy(*order).limit(position + 1)
    return first.withColumn("__n", F.row_number().over(Window.orderBy(*order))).where(F.col("__n") == position + 1).drop("__n")

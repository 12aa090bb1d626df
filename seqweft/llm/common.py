"""What the operators share: text as words, bounded filters, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.session import discard, read_table, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def body(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def doc_hash(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the bytes of an Arrow batch for the Python operators; a text that is longer makes a batch of its own.

    Spark reads this setting when a frame runs, so it stays set in the session. A smaller bound of the user's is left alone.
    """
    own = int(spark.conf.get(_BATCH, None) or 0)
    if not 0 < own <= most:
        spark.conf.set(_BATCH, str(most))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that can be reached, for each node with a link.

    Alternating large-star and small-star rounds; each round's edges are a table in the shared folder, and only their
    count and checksum come to the driver. A node's neighbours are never gathered: each round takes their minimum, and joins
    it back as a table of its own, so adaptive execution can split the partition of a node with very many links. A round's tables
    are deleted when the next one's links are there.
    Self-links and nulls are ignored; no links give no rows.
    """
    x, y = F.col(a), F.col(b)
    links = stored(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = stored(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        near = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(near, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, links = links, stored(small.unionByName(near.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(old, low, large, near)
        last, seen = seen, mark(links)
        if last == seen:
            break
    root = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())

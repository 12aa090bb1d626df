"""Exact dedup by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Lengths are counted first, from the texts' sizes alone. Only rows of a length that is shared get a prefix hash, and only rows whose
(length, prefix hash) is shared a full one. Which ones these are reaches the text scan as a filter
of at most BUCKETS rows, so it can be broadcast at any size of the corpus; a bucket that is hit by chance costs a hash
and changes no result. Shuffles carry lengths, hashes and ids, never texts, apart from the duplicates that keep_first()
has to compare. All of it is DataFrame expressions.

Null text counts as empty. Of equal texts the row with the largest doc_id stays (a null id is the smallest); of rows that
repeat id and text one stays. An empty table gives an empty table; other columns are never read for the decision.
Groups may be of any size: they are counted with partial aggregates and joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import body, table
from seqweft.session import stored

PREFIX_CHARS = 256
BUCKETS = 1 << 18


def _bucket(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int")


def _hits(df: DataFrame, bucket: Column, name: str) -> DataFrame:
    """The buckets of df's rows: BUCKETS rows at most."""
    return F.broadcast(df.select(bucket.alias("__bucket")).distinct().withColumn(name, F.lit(True)))


def suspects(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __bytes and __suspect: whether another row may share length and prefix. A prefix is hashed only where the length is shared."""
    size = F.octet_length(body(text))
    lengths = stored(docs.select(size.alias("__bytes")).groupBy("__bytes").agg(F.count("*").alias("__rows")).where("__rows > 1"), "lengths")
    sized = docs.withColumn("__bytes", size).withColumn("__bucket", _bucket(F.col("__bytes")))
    met = sized.join(_hits(lengths, _bucket(F.col("__bytes")), "__met"), "__bucket", "left").drop("__bucket")
    hashed = met.withColumn("__prefix", F.when(F.col("__met"), F.xxhash64(F.substring(body(text), 1, PREFIX_CHARS))))
    pairs = stored(hashed.where("__met").groupBy("__bytes", "__prefix").agg(F.count("*").alias("__rows")).where("__rows > 1"), "sketch")
    pair = _bucket(F.col("__bytes"), F.col("__prefix"))
    marked = hashed.withColumn("__bucket", F.when(F.col("__met"), pair))
    return marked.join(_hits(pairs, pair, "__hit"), "__bucket", "left").withColumn("__suspect", F.col("__hit").isNotNull()).drop("__bucket", "__hit", "__met", "__prefix")


def groups(rows: DataFrame) -> DataFrame:
    """(__bytes, __full) of the groups with more than one row: __last, the greatest (doc_id, __row), and __size."""
    found = rows.where("__suspect").groupBy("__bytes", "__full").agg(F.max(F.struct("doc_id", "__row")).alias("__last"), F.count("*").alias("__size"))
    return found.where("__size > 1")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    The digest column asks for every row's hash; groups are formed from the suspects' alone.
    """
    marked = suspects(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    rows = stored(marked.select("doc_id", "__bytes", "__suspect", F.sha2(body().cast("binary"), 256).alias("__full"), F.monotonically_increasing_id().alias("__row")), "hashed")
    joined = rows.join(stored(groups(rows), "groups"), ["__bytes", "__full"], "left")
    alone = F.col("__size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__last.doc_id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("__row") == F.col("__last.__row"))).alias("kept"),
        F.col("__full").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the dropped copies, columns unchanged. Rows that no other row resembles pass without a shuffle.

    What is left of repeated rows is told by other keys than the join's, or the join's hot partitions could not be split.
    """
    marked = suspects(docs, text)
    hashed = marked.where("__suspect").withColumn("__full", F.sha2(body(text).cast("binary"), 256))
    best = stored(hashed.groupBy("__bytes", "__full").agg(F.max(doc_id).alias("__keep"), F.count("*").alias("__size")), "best")
    stay = hashed.join(best, ["__bytes", "__full"]).where((F.col("__size") == 1) | F.col(doc_id).eqNullSafe(F.col("__keep")))
    return marked.where("not __suspect").select(*docs.columns).unionByName(stay.dropDuplicates(["__full", doc_id]).select(*docs.columns))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

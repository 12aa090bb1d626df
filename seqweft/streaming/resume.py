"""Resumable runs as streams: files that came since the last run, each once. Survey IDs in brackets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.sources.files import _fs

MARK = "_done-"


def versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the whole versions in target, oldest first."""
    folder, fs = _fs(spark, target)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removeprefix(MARK)) for n in names if n.startswith(MARK))


def read_latest(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """What upsert_latest() keeps in target; no rows if there is nothing yet."""
    done = versions(spark, target)
    return spark.read.schema(schema).parquet(f"{target}/v{done[-1]:012d}") if done else spark.createDataFrame([], schema)


def append_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Appends each(new JSON Lines rows) to target as Parquet; returns how many input rows were new [STM-01, STM-02, SNK-08].

    The checkpoint records which files are done; a second run without new files adds nothing. Output is exactly-once
    through the file sink's log, so an executor that is lost leaves no half batch.
    """
    stream = each(spark.readStream.schema(schema).json(source))
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def upsert_latest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], order: str) -> None:
    """Keeps the last row for each key in target: each batch is merged with what is there into a new version of the table [STM-03].

    A version is a folder of its own and counts once its mark is there, an empty file that is made after all data; so a batch that was
    stopped leaves the version before it, and one that is run again after its mark changes nothing. read_latest() reads the
    newest; older ones but the last are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        done = versions(session, target)
        if done and done[-1] >= number:
            return
        every = batch.unionByName(read_latest(session, target, schema)) if done else batch
        last = every.groupBy(*keys).agg(F.max_by(F.struct(*every.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{target}/v{number:012d}")
        mark, fs = _fs(session, f"{target}/{MARK}{number:012d}")
        fs.create(mark, False).close()
        for old in done[:-1]:
            for name in (f"{MARK}{old:012d}", f"v{old:012d}"):
                path, fs = _fs(session, f"{target}/{name}")
                fs.delete(path, True)

    query = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

"""Files and folders through the Hadoop file system, so any store that Spark reads. Survey IDs in brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def ensure_directory(spark: SparkSession, path: str) -> None:
    """[SNK-15, SNK-16]"""
    p, fs = _fs(spark, path)
    fs.mkdirs(p)


def clear_output(spark: SparkSession, path: str) -> None:
    """Deletes a folder and all below it; a missing one is no error [SNK-16]."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def count_files(spark: SparkSession, root: str) -> DataFrame:
    """folder (first component below root) and n_files at any depth; contents are not read [AG-12]."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path"))
    p, fs = _fs(spark, root)
    base = fs.getFileStatus(p).getPath().toString().rstrip("/")
    below = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(base.replace("file:///", "file:/")) + 2), F.length("path"))
    return listed.select(F.substring_index(below, "/", 1).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_files"))


def has_consistent_output(spark: SparkSession, path: str, expected: int) -> bool:
    """Whether the folder is there with as many files as expected, at least [JN-06]."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return False
    files, n = fs.listFiles(p, True), 0
    while files.hasNext() and n < max(expected, 1):
        files.next()
        n += 1
    return n >= expected


def rewrite(df: DataFrame, path: str, form: str = "json") -> None:
    """Replaces what is at path, which df may be read from [SNK-09].

    Written beside it first; then the old table is renamed, the new one takes its name, and the old one goes. At each moment a
    whole table is there under path, or under path.old, which the next call puts back.
    """
    spark = df.sparkSession
    aside, before = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    recover(spark, path)
    clear_output(spark, aside)
    writer = df.write.option("ignoreNullFields", False) if form == "json" else df.write
    writer.format(form).save(aside)
    new, fs = _fs(spark, aside)
    old, last = _fs(spark, path)[0], _fs(spark, before)[0]
    if fs.exists(old) and not fs.rename(old, last):
        raise OSError(f"could not rename {path}")
    if not fs.rename(new, old):
        fs.rename(last, old)
        raise OSError(f"could not rename {aside}")
    fs.delete(last, True)


def recover(spark: SparkSession, path: str) -> None:
    """Puts the table at path back, if rewrite() was stopped between its renames, or deletes what it left."""
    (old, fs), (last, _) = _fs(spark, path), _fs(spark, f"{path.rstrip('/')}.old")
    if fs.exists(last):
        if fs.exists(old):
            fs.delete(last, True)
        else:
            fs.rename(last, old)


def write_split(done: DataFrame, failed: DataFrame, target: str, dead_letters: str) -> None:
    """Good rows and dead letters, each appended to its own table [SNK-08, SNK-12]."""
    done.write.mode("append").option("ignoreNullFields", False).json(target)
    failed.write.mode("append").option("ignoreNullFields", False).json(dead_letters)

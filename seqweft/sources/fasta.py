"""FASTA files as rows, with errors as rows of their own. Survey IDs in brackets.

The text reader splits files at a line end before >, so a file of any size is read in ranges and a record is never cut. A
file with a byte that is not UTF-8 gives one read_error and no records; text before a file's first > gives a
malformed_record issue; a record without residues gives an empty_sequence issue.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.functions import text as X
from seqweft.functions.urls import parent_name
from seqweft.session import stored

FILE_NAME = "protein.faa"  # fixed value: the name that counts as a sequence file
BROADCAST_FILES = 50_000


@dataclass
class Parsed:
    records: DataFrame
    issues: DataFrame


def check_root(spark: SparkSession, root: str) -> None:
    """Raises if root is missing or a file [SRC-01, VAL-04]."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"no such root: {root}")
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"not a directory: {root}")


def discover(spark: SparkSession, root: str, pattern: str = FILE_NAME) -> DataFrame:
    """file_path of each sequence file below root, in order of path components [SRC-01, SRC-17, SRT-03]."""
    check_root(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("file_path")).orderBy(F.split("file_path", "/"))


def sample_files(files: DataFrame, sample: int | str | None) -> DataFrame:
    """The first files; None or 'all' for all of them [SRC-03, LIM-01]."""
    if sample in (None, "all"):
        return files
    if not isinstance(sample, int) or sample < 1:
        raise ValueError("sample: None, 'all' or a positive number")
    return files.limit(sample)


def read_fasta(spark: SparkSession, root: str, sample: int | str | None = None, pattern: str = FILE_NAME, file_path: bool = False) -> Parsed:
    """Records (T1, with file_path if asked for) and issues (T2) [SRC-02, SRC-03, SRC-04, STR-16, FLT-06]."""
    check_root(spark, root)
    chunks = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n>").text(root)
        .select("value", F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("at"))
    )
    if sample not in (None, "all"):
        first = sample_files(discover(spark, root, pattern), sample)
        name = lambda c: F.regexp_replace(c, "^file:/+", "/")
        chunks = chunks.join(first.select(name("file_path").alias("keep")), name(F.col("file_path")) == F.col("keep"), "left_semi")
    led = F.startswith(F.col("value"), F.lit(">"))
    files = chunks.groupBy("file_path").agg(F.min("at").alias("first"), F.min_by(led, "at").alias("led"), F.bool_or(~F.is_valid_utf8("value")).alias("unreadable"))
    odd = stored(files.where("unreadable or not led"), "odd")
    n = odd.count()
    if n:  # such files are rare; chunks are shuffled for them only where they are too many to broadcast
        marked = chunks.join(F.broadcast(odd) if n <= BROADCAST_FILES else odd, "file_path", "left")
    else:
        marked = chunks.withColumns({"first": F.lit(None).cast("long"), "led": F.lit(None).cast("boolean"), "unreadable": F.lit(None).cast("boolean")})
    rows = marked.withColumn("assembly_id", parent_name(F.col("file_path")))
    unreadable = F.coalesce("unreadable", F.lit(False))
    preamble = F.coalesce((F.col("at") == F.col("first")) & ~F.col("led"), F.lit(False))
    entry = F.when(led, F.substring(F.col("value"), F.lit(2), F.length("value"))).otherwise(F.col("value"))
    header = X.strip(F.substring_index(entry, "\n", 1))
    residues = F.regexp_replace(F.when(F.contains(entry, F.lit("\n")), F.substring(entry, F.locate("\n", entry) + 1, F.length(entry))).otherwise(F.lit("")), r"[ \r]|\s*\n\s*", "")
    parsed = rows.where(~unreadable & ~preamble).select(
        "file_path", "assembly_id", F.split(header, r"(?U)\s+", 2)[0].alias("sequence_id"), header.alias("raw_header"), X.strip(residues).alias("sequence")
    )
    full = parsed.where("sequence <> ''").select(
        "assembly_id",
        "sequence_id",
        X.ambiguous_residues(F.col("sequence")).alias("ambiguous_residues"),
        X.functional_annotation(F.col("raw_header")).alias("functional_annotations"),
        "raw_header",
        F.length("sequence").cast("bigint").alias("sequence_length"),
        "sequence",
        *(["file_path"] if file_path else []),
    )
    issue = lambda df, kind, message, of: df.select("file_path", "assembly_id", F.lit(kind).alias("issue_type"), F.lit(message).alias("issue_message"), of.cast("string").alias("record_identifier"))
    named = odd.withColumn("assembly_id", parent_name(F.col("file_path")))
    issues = (
        issue(named.where("unreadable"), "read_error", "the file is not UTF-8", F.lit(None))
        .unionByName(issue(rows.where(~unreadable & preamble & (X.strip(F.col("value")) != "")), "malformed_record", "text before the first record", F.lit(None)))
        .unionByName(issue(parsed.where("sequence = ''"), "empty_sequence", "the record has no residues", F.nullif(F.col("sequence_id"), F.lit(""))))
    )
    return Parsed(full, issues)


def corpus_to_parquet(parsed: Parsed, path: str) -> DataFrame:
    """Writes the records (zstd, overwriting) and reads them back; raises if there are none [SNK-01..03, SRC-05]."""
    spark = parsed.records.sparkSession
    parsed.records.write.mode("overwrite").option("compression", "zstd").parquet(path)
    corpus = spark.read.schema(parsed.records.schema).parquet(path)
    if corpus.isEmpty():
        raise RuntimeError("no record was parsed")
    return corpus

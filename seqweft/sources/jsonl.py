"""JSON Lines and CSV in and out. Survey IDs in brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweft.schemas import ddl


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str, ignore_missing: bool = False) -> DataFrame:
    """Rows of a declared schema; a bad line fails, blank lines are skipped [SRC-08..10, JSN-01, STR-14]."""
    if ignore_missing and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and value of one file, with its block and place; lines are numbered within the file's blocks, each by a task of its own."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    return numbered(rows, "line")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with their number, from 1, in order of block and place: the blocks' counts, a row for each, are summed up before."""
    counts = rows.groupBy("block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy("block").orderBy("place")))
    return placed.join(F.broadcast(counts.select("block", before.alias("__before"))), "block").withColumn(name, (F.col("__before") + F.col("__at")).cast("bigint")).drop("__before", "__at")


def validate_jsonl(spark: SparkSession, path: str) -> dict:
    """{valid, rows} or {valid, line, error} with the first bad physical line; blank lines are skipped [JSN-02]."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    found = lines.agg(F.count("*").alias("rows"), F.min(F.when(F.expr("try_parse_json(value)").isNull(), F.col("line"))).alias("line")).first()
    if found["line"] is None:
        return {"valid": True, "rows": found["rows"]}
    return {"valid": False, "line": found["line"], "error": f"Invalid JSON at {path}:{found['line']}"}


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """mode: overwrite, errorifexists or append; nulls are written out [SNK-05..08, SNK-10, SNK-11]."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_links_csv(spark: SparkSession, path: str) -> DataFrame:
    """[SRC-07]"""
    return spark.read.schema(ddl("bacteria_links")).option("header", True).csv(path)


def read_input_csv(spark: SparkSession, path: str) -> DataFrame:
    """bacteria_name, url and row_index (from 1 after the header); the first bad row ends the run, by number [SRC-16, VAL-02, WIN-04]."""
    lines = numbered_lines(spark, path).where((F.col("line") > 1) & (F.col("value") != ""))
    row = F.from_csv("value", ddl("bacteria_input"), {"mode": "PERMISSIVE"})
    width = F.size(F.regexp_extract_all("value", F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1))) - F.when(F.endswith("value", F.lit(",")), 0).otherwise(1)
    rows = numbered(lines, "row_index").select("row_index", "value", row.alias("r"), width.alias("width"))
    bad = ~F.is_valid_utf8("value") | (F.coalesce(F.trim("r.bacteria_name"), F.lit("")) == "") | (F.coalesce(F.trim("r.url"), F.lit("")) == "") | (F.col("width") != 2)
    first = rows.where(bad).agg(F.min("row_index")).first()[0]
    if first is not None:
        raise ValueError(f"{path}: row {first} has an empty value, other than two columns, or bytes that are not UTF-8")
    return rows.select("r.bacteria_name", "r.url", "row_index")


def write_preview(df: DataFrame, path: str, order: list[str], rows: int = 100) -> None:
    """The first rows in a stated order, as one CSV file [SNK-04, LIM-02]."""
    df.orderBy(*order).limit(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)

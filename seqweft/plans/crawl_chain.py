"""The crawl chain: index page to directory rows, tree, current versions, their children, version trees. Survey IDs in brackets.

Each step reads the table before it, skips what its own output already has, and appends; a second run over the same
pages adds nothing. Pages come from a function from URL to text, so a run can be offline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.operators import crawl
from seqweft.operators.dedupe import latest_done
from seqweft.schemas import ddl
from seqweft.session import stored
from seqweft.sources.fetch import fetch_pages
from seqweft.sources.files import write_split
from seqweft.sources.jsonl import read_jsonl, write_jsonl
from seqweft.sources.listing import directory_rows


def _done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_jsonl(spark, path, schema, ignore_missing=True).where(F.col("status") == "done")


def run(spark: SparkSession, index: DataFrame, once: Callable[[str], str], out: str, tasks: int = 1, dirs_only: bool = False) -> dict[str, int]:
    """index: url, html of the saved index. Returns how many rows each step added, failed ones apart [STM-02, TRV-01, SET-03]."""
    tables = {n: f"{out}/{n}" for n in ("bacteria_directory", "bacteria_tree", "latest_assembly_versions", "latest_assembly_tree", "assembly_version_tree", "files_warning")}
    added = {}
    listed = directory_rows(index)
    write_jsonl(listed.where("is_dir") if dirs_only else listed, tables["bacteria_directory"])

    def nested(source: DataFrame, target: str, child: str, keep: list[str]) -> None:
        rows = stored(crawl.pending(source, _done(spark, tables[target], ddl(target))), "pending")
        fetched = stored(fetch_pages(rows, once, tasks), "fetched")
        tree, lost = crawl.nest_children(rows, fetched, child, keep)
        tree, lost = stored(tree, "tree"), stored(lost, "lost")
        write_split(tree, lost, tables[target], tables["files_warning"])
        added[target], added[target + "_failed"] = tree.count(), lost.count()

    directory = read_jsonl(spark, tables["bacteria_directory"], ddl("bacteria_directory"))
    nested(directory, "bacteria_tree", "bacteria_name", ["bacteria_name", "source_url", "is_dir"])
    tree = read_jsonl(spark, tables["bacteria_tree"], ddl("bacteria_tree"))
    write_jsonl(crawl.latest_only(crawl.flatten(latest_done(tree, "source_url", "source_url"))), tables["latest_assembly_versions"])
    latest = read_jsonl(spark, tables["latest_assembly_versions"], ddl("latest_assembly_versions"))
    flat = ddl("latest_assembly_tree") + ", parent_url string"
    known = _done(spark, tables["latest_assembly_tree"], flat).select(F.col("parent_url").alias("source_url"))
    rows = stored(crawl.pending(latest, known), "pending")
    fetched = stored(fetch_pages(rows, once, tasks), "fetched")
    kids = stored(crawl.flat_children(rows, fetched), "kids")
    lost = crawl.nest_children(rows, fetched, "dir_name", ["bacteria_name", "source_url"])[1]
    write_split(kids, lost, tables["latest_assembly_tree"], tables["files_warning"])
    added["latest_assembly_tree"] = kids.count()
    versions = read_jsonl(spark, tables["latest_assembly_tree"], flat).select("bacteria_name", "source_url").distinct()
    nested(versions, "assembly_version_tree", "dir_name", ["bacteria_name", "source_url"])
    return added

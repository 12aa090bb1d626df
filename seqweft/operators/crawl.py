"""The crawl chain over page contents: listings to tables, trees, flattened subsets, resume and reconciliation. Survey IDs in brackets."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.functions import text as X
from seqweft.functions.urls import LATEST
from seqweft.operators.dedupe import latest_done
from seqweft.session import stored
from seqweft.sources.listing import links


def require_key(rows: DataFrame, key: str = "source_url", line: str = "line") -> DataFrame:
    """Fails on the first row without a key, by its line [VAL-01]."""
    bad = rows.where(F.col(key).isNull() | (F.col(key) == "")).agg(F.min(line)).first()[0]
    if bad is not None:
        raise ValueError(f"line {bad} has no {key}")
    return rows


def pending(rows: DataFrame, done: DataFrame, key: str = "source_url") -> DataFrame:
    """Input rows whose key is not done [JN-01, STM-02, SET-04]; a null key stays pending."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def groups_without(rows: DataFrame, key: str, hit: Column) -> DataFrame:
    """Rows of the groups in which no row is a hit; rows without a key are left out [JN-02, AG-13, UDF-02]."""
    return rows.where(F.col(key).isNotNull()).join(rows.where(hit).select(key).distinct(), key, "left_anti")


def bases(rows: DataFrame, key: str = "source_url", text: str = "text", label: str = LATEST) -> DataFrame:
    """Distinct non-null keys of the rows with the label [FLT-02, FLT-04, AG-07]"""
    return rows.where(F.col(text) == label).select(key).dropna().distinct()


def link_names(rows: DataFrame) -> DataFrame:
    """Without href, abs_url and name, then name anew from the URL; a missing column is an error [PRJ-02, PRJ-03]."""
    missing = {"href", "abs_url", "name"} - set(rows.columns)
    if missing:
        raise KeyError(f"no columns {sorted(missing)}")
    kept = rows.drop("href", "abs_url", "name").where(F.col("source_url").isNotNull())
    return kept.withColumn("name", X.name_in_url(F.col("source_url")))


def nest_children(rows: DataFrame, fetched: DataFrame, child: str, keep: list[str], region: str = "pre") -> tuple[DataFrame, DataFrame]:
    """(tree, warnings): each fetched row with its children in sub_dirs, status done; what was not fetched as dead letters.

    rows have source_url; fetched is fetch_pages() of them. A page without links gives an empty array [PRJ-10, ARR-02, ERR-01, SNK-12].
    """
    pages = fetched.dropDuplicates(["url"])
    found = links(pages.where("html is not null"), region)
    kids = found.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "abs_url", "is_directory"))).alias("k"))
    sub = F.transform("k", lambda x: F.struct(x["label"].alias(child), x["abs_url"].alias("source_url"), x["is_directory"].alias("is_dir")))
    nested = kids.select(F.col("url").alias("source_url"), sub.alias("sub_dirs"))
    none = F.array().cast(nested.schema["sub_dirs"].dataType)
    status = pages.select(F.col("url").alias("source_url"), F.col("html").isNotNull().alias("__ok"), "http_status", "error_code", "error_message")
    joined = rows.join(status, "source_url").join(nested, "source_url", "left")
    tree = joined.where("__ok").select(*keep, F.coalesce("sub_dirs", none).alias("sub_dirs"), F.lit("done").alias("status"))
    lost = joined.where("not __ok")
    name = F.col("bacteria_name") if "bacteria_name" in rows.columns else F.lit(None).cast("string")
    warnings = lost.select(name.alias("bacteria_name"), "source_url", F.lit("failed").alias("status"), "http_status", F.coalesce("error_code", F.lit("-")).alias("error_code"), F.substring("error_message", 1, 200).alias("error_message"))
    return tree, warnings


def flatten(tree: DataFrame) -> DataFrame:
    """T5: done rows' children with the parent's name; empty arrays give none [ARR-01, PRJ-05]."""
    rows = tree.where(F.col("status") == "done").select("bacteria_name", F.explode("sub_dirs").alias("d"))
    return rows.select("bacteria_name", F.col("d.source_url"), F.col("d.is_dir"), F.col("d.bacteria_name").alias("folder_name"))


def latest_only(flat: DataFrame) -> DataFrame:
    """[FLT-03]"""
    return flat.where(F.col("folder_name") == LATEST)


def flat_children(rows: DataFrame, fetched: DataFrame, region: str = "pre") -> DataFrame:
    """T6 with parent_url, by which a rerun knows what is done, whatever the children's URLs [ARR-05]."""
    found = links(fetched.where("html is not null").dropDuplicates(["url"]), region)
    joined = rows.select("bacteria_name", F.col("source_url").alias("parent_url")).join(found, F.col("url") == F.col("parent_url"))
    return joined.select("bacteria_name", F.col("label").alias("dir_name"), F.col("abs_url").alias("source_url"), F.col("is_directory").alias("is_dir"), F.lit("done").alias("status"), "parent_url")


def complete_counts(tree: DataFrame) -> DataFrame:
    """n_rows, which is what the printed figure was, and n_with_children, which was meant [AG-11, AG-15]."""
    return tree.agg(F.count("*").alias("n_rows"), F.count_if(F.size("sub_dirs") > 0).alias("n_with_children"), F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def resume(prior: DataFrame, fresh: DataFrame, key: str = "source_url", order: str = "line", dedupe: bool = True) -> DataFrame:
    """Kept rows of the prior output and the new ones [SET-02, SET-03]."""
    return latest_done(prior, key, order, dedupe=dedupe).drop(order).unionByName(fresh)


def traverse(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """node, level: all that can be reached from the roots, by breadth-first fronts; a seen node is not visited again [TRV-01].

    edges: parent, child. Each front is a table in the shared folder; the loop ends with an empty front. Nodes beyond `most` levels, if that is given, are an error.
    """
    seen = stored(roots.select(F.col(roots.columns[0]).alias("node")).where("node is not null").distinct().withColumn("level", F.lit(0).cast("bigint")), "front")
    front = seen
    for level in count(1):
        reached = edges.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).where("node is not null").distinct()
        front = stored(reached.join(seen, "node", "left_anti").withColumn("level", F.lit(level).cast("bigint")), "front")
        if front.isEmpty():
            return seen
        if most is not None and level > most:
            raise ValueError(f"nodes beyond {most} levels")
        seen = stored(seen.unionByName(front), "seen")


def availability(targets: DataFrame, fetched: DataFrame) -> DataFrame:
    """targets with availability: available or unavailable by whether their page was fetched, pending where nobody tried [TRV-02]."""
    tried = fetched.select(F.col("url").alias("source_url"), F.col("html").isNotNull().alias("__ok")).groupBy("source_url").agg(F.bool_or("__ok").alias("__ok"))
    state = F.when(F.col("__ok").isNull(), "pending").when(F.col("__ok"), "available").otherwise("unavailable")
    return targets.join(tried, "source_url", "left").withColumn("availability", state).drop("__ok")


def reconcile(current: DataFrame, prior: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and action [JN-04, JN-06, STM-03]: reuse where the prior row is complete and its files are there, else reprocess; process if new.

    prior: keys, completed, expected. found: keys, n_files. Keys are joined column by column, never pasted together [JN-03].
    """
    known = prior.select(*keys, "completed", "expected")
    joined = current.select(*keys).distinct().join(known, keys, "left").join(found.select(*keys, "n_files"), keys, "left")
    enough = F.coalesce("n_files", F.lit(0)) >= F.coalesce("expected", F.lit(0))
    action = F.when(F.col("completed").isNull(), "process").when(F.col("completed") & enough, "reuse").otherwise("clear_and_reprocess")
    return joined.select(*keys, action.alias("action"))


def one_summary(current: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose summaries are other than one, or that are not in the input, with the count [VAL-07]."""
    counts = summaries.groupBy(*keys).agg(F.count("*").alias("n_summaries"))
    inputs = current.select(*keys).distinct().withColumn("__in", F.lit(True))
    both = inputs.join(counts, keys, "full").withColumns({"n_summaries": F.coalesce("n_summaries", F.lit(0)), "in_input": F.coalesce("__in", F.lit(False))}).drop("__in")
    return both.where((F.col("n_summaries") != 1) | ~F.col("in_input"))


def summary_rows(targets: DataFrame, versions: DataFrame) -> DataFrame:
    """A summary for each target: versions, counts and completion [ARR-06]. versions: source_url, version_url, version_label, n_files, complete."""
    per = versions.groupBy("source_url").agg(F.array_sort(F.collect_list(F.struct("version_url", "version_label"))).alias("versions"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("files"), F.bool_and("complete").alias("complete"))
    none = F.array().cast("array<struct<version_url:string,version_label:string>>")
    rows = targets.join(per, "source_url", "left")
    there = F.col("availability") == "available"
    status = F.when(~there, "skipped").when(F.coalesce("complete", F.lit(False)), "success").otherwise("failed")
    return rows.select(
        "bacteria_name", "source_url", there.alias("latest_assembly_versions_available"), F.coalesce(F.size("versions"), F.lit(0)).cast("bigint").alias("discovered_version_count"), F.coalesce("files", F.lit(0)).cast("bigint").alias("downloaded_file_count"),
        (there & F.coalesce("complete", F.lit(False))).alias("download_completed"), F.coalesce("versions", none).alias("versions"), status.alias("status"), F.when(status == "failed", "not all files are there").alias("error_message"),
    )


def success_ratio(done: Column, whole: Column) -> Column:
    """[AG-26]"""
    return F.coalesce(F.try_divide(F.sum(done).cast("double"), F.sum(whole).cast("double")), F.lit(0.0))


STATUSES = ("success", "skipped", "failed")  # fixed values of the summary's status


def summary_violations(rows: DataFrame) -> DataFrame:
    """rows with violations: the names of broken rules, joined [VAL-05, JSN-04]."""
    c = F.col
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    rules = {
        "bacteria_name": blank(c("bacteria_name")),
        "source_url": blank(c("source_url")),
        "counts": F.coalesce(F.least("discovered_version_count", "downloaded_file_count"), F.lit(-1)) < 0,
        "flags": c("latest_assembly_versions_available").isNull() | c("download_completed").isNull(),
        "status": ~F.coalesce(c("status").isin(*STATUSES), F.lit(False)),
        "failed_without_message": F.coalesce(c("status") == "failed", F.lit(False)) & blank(c("error_message")),
        "versions": c("versions").isNull() | F.exists(F.coalesce(c("versions"), F.array().cast("array<struct<version_url:string,version_label:string>>")), lambda v: blank(v["version_url"]) | blank(v["version_label"])),
    }
    return rows.withColumn("violations", F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in rules.items()]))

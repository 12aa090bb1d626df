"""Queries that write the driver's tables as files in the shared folder and read them back, each beside its DuckDB twin. Survey IDs in brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.functions import text as X
from seqweft.functions.text import CANONICAL
from seqweft.operators import crawl, profile, tokens
from seqweft.plans.adapters import CORPUS_SQL, corpus, table
from seqweft.plans.queries import query
from seqweft.plans.run import Manifest, RunConfig
from seqweft.schemas import ddl
from seqweft.session import shared_path, stored
from seqweft.sources import fasta, files, jsonl, listing
from seqweft.sources.fetch import FetchError, fetch_pages
from seqweft.streaming.resume import append_new, read_latest, upsert_latest

# FASTA: parts as records, a folder for each brand; every 50th has no residues, and some have more than one line.

_FASTA = f"""
WITH f AS (SELECT 'brand=' || p_brand AS assembly_id, 'P' || p_partkey AS sequence_id, 'P' || p_partkey || ' ' || p_name || ' [' || p_type || ']' AS raw_header,
  CASE WHEN p_partkey % 50 = 0 THEN '' ELSE upper(regexp_replace(p_name || p_type, '[^A-Za-z]', '', 'g')) END AS sequence FROM part WHERE p_brand IS NOT NULL),
full_ AS (SELECT assembly_id, sequence_id, array_to_string(list_sort(list_filter(list_distinct(string_split(sequence, '')), lambda c: c <> '' AND NOT contains('{CANONICAL}', c))), '') AS ambiguous_residues,
  trim(split_part(substr(raw_header, strpos(raw_header, ' ') + 1), '[', 1)) AS functional_annotations, raw_header, length(sequence) AS sequence_length, sequence FROM f WHERE sequence <> '')
"""


def _fasta_files(spark: SparkSession, sf_dir: str) -> str:
    name, half = F.concat("p_name", F.lit(" ["), "p_type", F.lit("]")), F.lit(7)
    seq = F.upper(F.regexp_replace(F.concat("p_name", "p_type"), "[^A-Za-z]", ""))
    lines = F.when(F.col("p_partkey") % 50 == 0, F.lit("")).otherwise(F.concat(F.lit("\n"), F.substring(seq, F.lit(1), half), F.lit("\n"), F.substring(seq, half + 1, F.length(seq))))
    root = shared_path(spark, "fasta")
    rows = table(spark, sf_dir, "part").where("p_brand is not null").select(F.col("p_brand").alias("brand"), F.concat(F.lit(">P"), "p_partkey", F.lit(" "), name, lines).alias("value"))
    rows.write.partitionBy("brand").text(root)
    return root


@query(_FASTA + "SELECT * FROM full_")
def fasta_records(spark, sf_dir):
    """Files found, split, parsed and written as Parquet [SRC-01..04, SNK-01..03, STR-16, FLT-06]."""
    parsed = fasta.read_fasta(spark, _fasta_files(spark, sf_dir), pattern="*.txt")
    return fasta.corpus_to_parquet(parsed, shared_path(spark, "corpus")).withColumn("assembly_id", F.replace("assembly_id", F.lit("%23"), F.lit("#")))


@query(_FASTA + "SELECT assembly_id, 'empty_sequence' AS issue_type, sequence_id AS record_identifier FROM f WHERE sequence = ''")
def fasta_issues(spark, sf_dir):
    """[SRC-03, VAL-04]"""
    issues = fasta.read_fasta(spark, _fasta_files(spark, sf_dir), pattern="*.txt").issues
    return issues.select(F.replace("assembly_id", F.lit("%23"), F.lit("#")).alias("assembly_id"), "issue_type", "record_identifier")


@query(_FASTA + "SELECT 'empty_sequence' AS issue_type, count(*) AS n FROM f WHERE sequence = '' HAVING count(*) > 0")
def fasta_issue_summary(spark, sf_dir):
    """[AG-10, AG-27]"""
    found = profile.issue_summary(fasta.read_fasta(spark, _fasta_files(spark, sf_dir), pattern="*.txt").issues)
    return found.groupBy("issue_type").agg(F.sum("n").alias("n"))


@query("SELECT 'brand=' || p_brand AS folder, 1::BIGINT AS n_files FROM part GROUP BY p_brand")
def files_per_folder(spark, sf_dir):
    """[AG-12, SNK-15, SNK-16]"""
    root = shared_path(spark, "folders")
    table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("value")).repartition(1).write.partitionBy("brand").text(root)
    counted = files.count_files(spark, root).where("folder like 'brand=%'")
    return counted.select(F.replace("folder", F.lit("%23"), F.lit("#")).alias("folder"), "n_files")


# JSON Lines and CSV


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    """[SRC-08..10, SNK-05, SNK-06, SNK-10, JSN-01, STR-14]"""
    rows, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), shared_path(spark, "jsonl")
    jsonl.write_jsonl(rows, path, "errorifexists")
    return jsonl.read_jsonl(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes))


@query("SELECT true AS valid, count(*) AS rows FROM events")
def jsonl_validated(spark, sf_dir):
    """[JSN-02]"""
    path = shared_path(spark, "jsonl")
    jsonl.write_jsonl(table(spark, sf_dir, "events").select("event_id", "props").coalesce(1), path)
    return spark.createDataFrame([jsonl.validate_jsonl(spark, path)], "valid boolean, rows bigint")


@query("SELECT false AS valid, 7::BIGINT AS line")
def jsonl_first_bad_line(spark, sf_dir):
    """[JSN-02]"""
    path = shared_path(spark, "jsonl")
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1)
    rows.select(F.when(F.col("n_nationkey").isin(6, 9), "{broken").otherwise(F.to_json(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)
    found = jsonl.validate_jsonl(spark, path)
    return spark.createDataFrame([(found["valid"], found["line"])], "valid boolean, line bigint")


@query("SELECT n_name AS bacteria_name, 'https://h/' || n_nationkey || '/' AS url, row_number() OVER (ORDER BY n_nationkey) AS row_index FROM nation")
def csv_input(spark, sf_dir):
    """[SRC-16, VAL-02, WIN-04]"""
    path = shared_path(spark, "csv")
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select(F.col("n_name").alias("bacteria_name"), F.concat(F.lit("https://h/"), "n_nationkey", F.lit("/")).alias("url"))
    rows.write.option("header", True).csv(path)
    return jsonl.read_input_csv(spark, path)


@query("SELECT url AS source_url, 'page ' || page_id AS text, '/' || page_id AS href, url AS abs_url, 'n, ' || page_id AS name FROM pages")
def csv_links(spark, sf_dir):
    """[SRC-07, STR-15]"""
    path, n = shared_path(spark, "csv"), F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("source_url"), F.concat(F.lit("page "), n).alias("text"), F.concat(F.lit("/"), n).alias("href"), F.col("url").alias("abs_url"), F.concat(F.lit("n, "), n).alias("name"))
    rows.write.option("header", True).csv(path)
    return jsonl.read_links_csv(spark, path)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def table_rewritten(spark, sf_dir):
    """A table replaced by a part of itself [SNK-09]."""
    path = shared_path(spark, "rewritten")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.json(path)
    schema = "n_nationkey int, n_name string"
    files.rewrite(jsonl.read_jsonl(spark, path, schema).where("n_nationkey % 2 = 0"), path)
    return jsonl.read_jsonl(spark, path, schema)


# Listings and fetched pages

_NAV = """WITH n AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">.*?</a>') AS a FROM pages),
l AS (SELECT url, pos - 1 AS pos, regexp_extract(a[pos], 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(a[pos], '(?s)>(.*)</a>', 1), '<[^>]*>', '', 'g')) AS label FROM n, range(1, len(a) + 1) r(pos))
"""


@query(_NAV + "SELECT url, pos, href, label, ends_with(href, '/') AS is_directory FROM l WHERE label <> 'Parent Directory'")
def page_links_parsed(spark, sf_dir):
    """The parser's links by the rule `exact` [LNK-01, LNK-04]."""
    return listing.exact_links(table(spark, sf_dir, "pages"), "nav", "exact").drop("abs_url")


@query(_NAV + """SELECT regexp_replace(label, '/$', '') AS bacteria_name, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS source_url, ends_with(href, '/') AS is_dir
FROM l WHERE href <> '' AND href <> '../' AND NOT contains(lower(label), 'parent directory')""")
def index_rows(spark, sf_dir):
    """[LNK-02, SRC-11, FLT-08, STR-11]"""
    return listing.directory_rows(table(spark, sf_dir, "pages").where("contains(html, '<nav>')"), "nav")


@query("""SELECT url AS base_url, rtrim(url, '/') || '/latest_assembly_versions/' AS latest_url, page_id % 3 <> 0 AS ok, CASE WHEN page_id % 3 = 0 THEN 'not_fetched' END AS error,
CASE WHEN page_id % 3 = 0 THEN '' ELSE 'GCA_' || page_id || ',GCF_' || page_id END AS assemblies FROM pages""")
def latest_listings(spark, sf_dir):
    """[LNK-03, SRC-14, ARR-04]"""
    n = F.col("page_id")
    html = F.concat(F.lit('<pre><a href="../">Parent Directory</a>\n<a href="a/">GCA_'), n, F.lit('/</a>\n<a href="n.txt">n.txt</a><a href="b/">GCF_'), n, F.lit('//</a></pre><pre><a href="z/">z/</a></pre>'))
    pages = table(spark, sf_dir, "pages").select("url", F.when(n % 3 != 0, html).alias("html"))
    return listing.latest_listing(pages).withColumn("assemblies", F.array_join("assemblies", ","))


def _page(url: str) -> str:
    """A listing for the keys of even numbers; others are gone, and every tenth is busy at first."""
    n = int(url.rpartition("/")[2])
    if n % 2:
        raise FetchError("gone", 404)
    return f'<pre><a href="../">Parent Directory</a><a href="v{n}/">v{n}/</a><a href="r.txt">r.txt</a></pre>'


_FETCHED = "WITH c AS (SELECT c_custkey AS n, c_name AS bacteria_name, 'https://h/' || c_custkey AS source_url FROM customer) "


def _nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(table(spark, sf_dir, "customer").select(F.col("c_name").alias("bacteria_name"), F.concat(F.lit("https://h/"), "c_custkey").alias("source_url")), "rows")
    fetched = stored(fetch_pages(rows, _page, tasks=4), "fetched")
    return crawl.nest_children(rows, fetched, "dir_name", ["bacteria_name", "source_url"])


@query(_FETCHED + "SELECT bacteria_name, source_url, 'done' AS status, 'v' || n || '/=https://h/v' || n || '/,r.txt=https://h/r.txt' AS sub_dirs FROM c WHERE n % 2 = 0")
def fetched_tree(spark, sf_dir):
    """[PRJ-10, ARR-02, UDF-03, SRC-12, SRC-13, SNK-08]"""
    shown = F.array_join(F.transform("sub_dirs", lambda d: F.concat(d["dir_name"], F.lit("="), d["source_url"])), ",")
    return _nested(spark, sf_dir)[0].select("bacteria_name", "source_url", "status", shown.alias("sub_dirs"))


@query(_FETCHED + "SELECT bacteria_name, source_url, 'failed' AS status, 404 AS http_status, '-' AS error_code, 'gone' AS error_message FROM c WHERE n % 2 = 1")
def fetch_warnings(spark, sf_dir):
    """Dead letters, appended to a table of their own and read back [ERR-01, SNK-12]."""
    tree, lost = _nested(spark, sf_dir)
    root = shared_path(spark, "split")
    files.write_split(tree, lost, f"{root}/tree", f"{root}/lost")
    return jsonl.read_jsonl(spark, f"{root}/lost", ddl("files_warning"))


@query("SELECT n_nationkey, n_name FROM nation")
def keys_required(spark, sf_dir):
    """[VAL-01, FLT-12]"""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("line"))
    return crawl.require_key(rows, "n_name").drop("line")


@query("SELECT p_partkey, 'S_' || p_partkey AS name FROM part")
def link_names(spark, sf_dir):
    """[PRJ-02]"""
    url = F.concat(F.lit("https://h/bacteria/S_"), "p_partkey", F.lit("/"))
    rows = table(spark, sf_dir, "part").select("p_partkey", url.alias("source_url"), F.lit("h").alias("href"), F.lit("a").alias("abs_url"), F.lit("old").alias("name"))
    return crawl.link_names(rows).select("p_partkey", "name")


# Streams


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def stream_appended(spark, sf_dir):
    """Two runs over files that come in between; each file is taken once [STM-01, STM-02, SNK-07, SNK-08]."""
    root, schema = shared_path(spark, "stream"), "o_orderkey bigint, o_totalprice double"
    rows = table(spark, sf_dir, "orders")
    for status in ("F", "O"):
        jsonl.write_jsonl(rows.where(F.col("o_orderstatus") == status).select("o_orderkey", F.col("o_totalprice").cast("double")), f"{root}/in", "append")
        append_new(spark, f"{root}/in", schema, f"{root}/out", f"{root}/check")
    return spark.read.schema(schema).parquet(f"{root}/out")


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stream_upserted(spark, sf_dir):
    """[STM-03]"""
    root, schema = shared_path(spark, "upsert"), "user_id bigint, event_id bigint"
    rows = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id")
    for part in (1, 0):
        jsonl.write_jsonl(rows.where(F.col("event_id") % 2 == part), f"{root}/in", "append")
        upsert_latest(spark, f"{root}/in", schema, f"{root}/out", f"{root}/check", ["user_id"], "event_id")
    return read_latest(spark, f"{root}/out", schema)


# Runs


@query("SELECT 'in' AS data_root, 'out' AS output_root, 'all' AS sample, 'drop' AS ambiguous_residue_mode, 'keep' AS rare_residue_policy, '512' AS max_length")
def run_config(spark, sf_dir):
    """[VAL-03, PRJ-08]"""
    return RunConfig("in", "out", ambiguous_residue_mode="drop").table(spark).drop("strategies", "bpe_sizes")


@query("""SELECT * FROM (VALUES ('lengths', 'table', 'parquet', 'out/raw/lengths.parquet', 'all', 'raw', false), ('lengths_preview', 'preview', 'csv', 'out/raw/lengths_preview.csv', 'all', 'raw', true))
v(artifact_name, artifact_role, storage_format, path, analysis_scope, source_view, is_preview)""")
def manifest_rows(spark, sf_dir):
    """[SNK-14, VAL-06]"""
    manifest = Manifest({})
    manifest.add("lengths", "table", "parquet", "out/raw/lengths.parquet")
    manifest.add("lengths_preview", "preview", "csv", "out/raw/lengths_preview.csv", preview=True)
    return spark.createDataFrame([tuple(a.values()) for a in manifest.artifacts], ddl("saved_artifact"))


_STRATEGIES = " UNION ALL ".join(
    f"""SELECT '{name}' AS strategy_name, (SELECT count(DISTINCT CASE WHEN regexp_matches(token, '[^{CANONICAL}]') THEN '<unk>' ELSE token END) FROM
  (SELECT unnest(list_transform(range(1, greatest(length(sequence) - {k - 1}, 0) + 1), lambda i: substr(sequence, i, {k}))) AS token FROM corpus)) AS vocabulary_size,
  (SELECT quantile_cont(greatest(sequence_length - {k - 1}, 0), 0.5)::DOUBLE FROM corpus) AS median_tokenized_length"""
    for name, k in tokens.STRATEGIES.items()
)


@query(CORPUS_SQL + _STRATEGIES)
def tokenization_unk(spark, sf_dir):
    """All strategies under replace_with_unk [RES-02, TOK-06, TOK-07]."""
    rows, out = corpus(spark, sf_dir), None
    for name in tokens.STRATEGIES:
        one = tokens.strategy_summary(rows, name, policy="replace_with_unk").select("strategy_name", "vocabulary_size", "median_tokenized_length")
        out = one if out is None else out.unionByName(one)
    return out


@query(CORPUS_SQL + f""", n AS (SELECT s, k, greatest(sequence_length - k + 1, 0) AS t FROM corpus, (VALUES ('3-mer', 3), ('5-mer', 5)) v(s, k)),
e AS (SELECT s, k, count(*) FILTER (t > 512) / count(*)::DOUBLE AS f FROM n GROUP BY ALL),
v AS (SELECT 3 AS k, count(DISTINCT token) AS vocab FROM (SELECT unnest(list_transform(range(1, greatest(length(sequence) - 2, 0) + 1), lambda i: substr(sequence, i, 3))) AS token FROM corpus)
  UNION ALL SELECT 5, count(DISTINCT token) FROM (SELECT unnest(list_transform(range(1, greatest(length(sequence) - 4, 0) + 1), lambda i: substr(sequence, i, 5))) AS token FROM corpus))
SELECT s || '/fixed' AS recommended, (SELECT count(*) FROM e) AS n_strategies FROM e JOIN v USING (k) ORDER BY f, vocab LIMIT 1""")
def recommendation(spark, sf_dir):
    """[REC-01]"""
    rows = corpus(spark, sf_dir)
    found = tokens.recommend([tokens.strategy_summary(rows, s).first().asDict() for s in ("3-mer", "5-mer")])
    return spark.createDataFrame([(found["recommended"], len(found["findings"]))], "recommended string, n_strategies bigint")


@query(CORPUS_SQL + f"""SELECT sequence_id, regexp_extract_all(raw_header, '\\[([^\\]]*)\\]', 1)[1] AS curation_hint, length(translate(sequence, '{CANONICAL}', '')) > 0 AS needs_review FROM corpus""")
def curation_hints(spark, sf_dir):
    """The header's first annotation, and whether residues need a look [HDR-02]."""
    rows = corpus(spark, sf_dir)
    first = F.try_element_at(X.header_fields(F.col("raw_header"))["annotations"], F.lit(1))
    return rows.select("sequence_id", first.alias("curation_hint"), (F.length(F.translate("sequence", CANONICAL, "")) > 0).alias("needs_review"))


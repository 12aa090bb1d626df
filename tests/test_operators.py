import pytest
from pyspark.sql import functions as F

from seqweft.operators import crawl, dedupe, profile, tokens
from seqweft.schemas import ddl
from seqweft.streaming.resume import append_new, read_latest, upsert_latest


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def seqs(spark, *pairs):
    df = spark.createDataFrame([(a, f"s{i}", s) for i, (a, s) in enumerate(pairs)], "assembly_id string, sequence_id string, sequence string")
    return df.withColumn("sequence_length", F.length("sequence").cast("bigint"))


def test_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (4, "z")], "a int, b string")
    assert [tuple(r) for r in profile.null_profile(df).collect()] == [("b", "string", 1, 3, 0.25), ("a", "int", 0, 4, 0.0)]
    assert profile.null_profile(df.limit(0)).first().null_fraction == 0.0


def test_duplicates(spark):
    corpus = seqs(spark, ("a", "S1"), ("a", "S1"), ("b", "S1"), ("b", "S2"), ("c", "S3"), ("c", "S3"))
    got = {r.duplicate_scope: (r.duplicate_group_count, r.duplicate_sequence_count, round(r.duplicate_rate, 4)) for r in dedupe.duplicate_summary(corpus).collect()}
    assert got == {"overall": (2, 3, 0.5), "within_assembly": (2, 2, 0.3333), "across_assemblies": (1, 1, 0.1667)}
    assert dedupe.candidates(corpus).count() == 3
    assert dedupe.flag_duplicates(corpus).where("is_duplicate").count() == 5
    assert {r.kept_sequence_id for r in dedupe.provenance(corpus).collect()} == {"s0", "s3", "s4"}
    empty = {r.duplicate_scope: r.duplicate_rate for r in dedupe.duplicate_summary(corpus.limit(0)).collect()}
    assert set(empty.values()) == {0.0}


def test_tokens(spark):
    corpus = seqs(spark, ("a", "MKVLL"), ("a", "MK"))
    assert rows_of(tokens.token_frequency(corpus, "3-mer")) == [("KVL", 1), ("MKV", 1), ("VLL", 1)]
    assert rows_of(tokens.token_frequency(corpus, "5-mer")) == [("MKVLL", 1)]
    assert sum(r.n for r in tokens.token_frequency(corpus, "single").collect()) == 7
    assert dict(tokens.token_frequency(seqs(spark, ("a", "MXKVLL")), "3-mer", "replace_with_unk").collect()) == {"<unk>": 2, "KVL": 1, "VLL": 1}
    edge = seqs(spark, ("a", "M" * 512), ("a", "M" * 513), ("a", ""))
    got = {r.strategy_name: (r.n_exceeding, r.n_windows) for r in tokens.exceedance(edge).collect()}
    assert got == {"single": (1, 3), "3-mer": (0, 2), "5-mer": (0, 2)}


def test_policies(spark):
    corpus = seqs(spark, ("a", "MKV"), ("a", "MBX"))
    assert [r.sequence for r in tokens.apply_policy(corpus, "normalize").orderBy("sequence_id").collect()] == ["MKV", "MDX"]
    assert tokens.apply_policy(corpus, "drop").count() == 1
    got = {r.policy_name: (r.is_primary_policy, r.affected_sequence_count, r.kept_sequence_count, r.ambiguous_left) for r in tokens.policy_sensitivity(corpus, "drop").collect()}
    assert got == {"keep": (False, 0, 2, 2), "replace_with_unk": (False, 1, 2, 0), "normalize": (False, 1, 2, 1), "drop": (True, 1, 1, 0)}
    with pytest.raises(ValueError):
        tokens.apply_policy(corpus, "other")


def test_bpe(spark):
    corpus = seqs(spark, *[("a", "MKVLLMKVAA" * n) for n in range(1, 6)])
    model = tokens.train_bpe(tokens.bpe_sample(corpus), 20)
    assert all("".join(r.tokens) == s.sequence for r, s in zip(tokens.encode_bpe(corpus, model).orderBy("sequence_id").collect(), corpus.orderBy("sequence_id").collect(), strict=True))
    got = tokens.bpe_summary(corpus, (20,)).collect()
    assert [r.variant_label.split(":")[0] for r in got] == ["fixed_grid", "corpus_informed"]
    best = tokens.recommend([r.asDict() for r in got])
    assert all(len(f) >= 3 for f in best["findings"].values())


def test_bpe_query_has_the_grid(spark):
    from seqweft.plans.registry import QUERIES

    got = {r.variant_label for r in QUERIES["bpe_summary"](spark, "/root/testdata/sf0.001").select("variant_label").collect()}
    assert {f"fixed_grid:{s}" for s in (1000, 4000, 8000)} <= got and len(got) == 4


def test_crawl_state(spark):
    prior = spark.createDataFrame([("u1", "done", 1), ("u2", "failed", 2), ("u1", "done", 3)], "source_url string, status string, line int")
    assert [r.line for r in dedupe.latest_done(prior, "source_url", "line").collect()] == [3]
    assert dedupe.latest_done(prior, "source_url", "line", dedupe=False).count() == 2
    current = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3)], "source_url string, line int")
    assert sorted(r.source_url for r in crawl.pending(current, prior.where("status = 'done'")).collect()) == ["u2", "u3"]
    with pytest.raises(ValueError, match="line 2"):
        crawl.require_key(spark.createDataFrame([("u", 1), ("", 2), (None, 3)], "source_url string, line int"))


def test_tree(spark):
    schema = "bacteria_name string, source_url string, is_dir boolean, sub_dirs array<struct<bacteria_name:string,source_url:string,is_dir:boolean>>, status string"
    kid = lambda n: (n, "https://h/" + n, n.endswith("/"))
    tree = spark.createDataFrame([("A", "a", True, [kid("latest_assembly_versions/"), kid("x.txt")], "done"), ("B", "b", True, [], "failed"), ("C", "c", True, [], "done"), ("D", "d", True, [kid("r/")], "done")], schema)
    flat = crawl.flatten(tree)
    assert sorted(r.bacteria_name for r in flat.collect()) == ["A", "A", "D"]
    assert [r.bacteria_name for r in crawl.latest_only(flat).collect()] == ["A"]
    assert tuple(crawl.complete_counts(tree).first()) == (4, 2, 3, 1)


def test_chain(spark):
    """Listing to directory rows, tree, flat rows and dead letters; a second run has nothing left to do."""
    rows = spark.createDataFrame([("A", "https://h/A/", True), ("B", "https://h/B/", True), ("C", "https://h/C/", True)], "bacteria_name string, source_url string, is_dir boolean")
    fetched = spark.createDataFrame(
        [("https://h/A/", '<pre><a href="latest_assembly_versions/">latest_assembly_versions/</a></pre>', None, None, None), ("https://h/B/", None, 404, None, "gone"), ("https://h/C/", "<p/>", None, None, None)],
        "url string, html string, http_status int, error_code string, error_message string",
    )
    tree, warnings = crawl.nest_children(rows, fetched, "bacteria_name", ["bacteria_name", "source_url", "is_dir"])
    assert {r.bacteria_name: len(r.sub_dirs) for r in tree.collect()} == {"A": 1, "C": 0}
    assert rows_of(warnings) == [("B", "https://h/B/", "failed", 404, "-", "gone")]
    assert [r.source_url for r in crawl.latest_only(crawl.flatten(tree)).collect()] == ["https://h/A/latest_assembly_versions/"]
    assert [(r.dir_name, r.parent_url) for r in crawl.flat_children(rows, fetched).collect()] == [("latest_assembly_versions/", "https://h/A/")]
    assert sorted(r.bacteria_name for r in crawl.pending(rows, tree).collect()) == ["B"]
    state = {r.bacteria_name: r.availability for r in crawl.availability(rows.union(spark.createDataFrame([("D", "d", True)], rows.schema)), fetched).collect()}
    assert state == {"A": "available", "B": "unavailable", "C": "available", "D": "pending"}


def test_links(spark):
    links = spark.createDataFrame(
        [("https://h/bacteria/Esch_coli/", "latest_assembly_versions/", 1, 1, 1), ("https://h/bacteria/Esch_coli/", "all_assembly_versions/", 1, 1, 1), ("https://h/bacteria/Other/", "README.txt", 1, 1, 1), (None, "latest_assembly_versions/", 1, 1, 1)],
        "source_url string, text string, href int, abs_url int, name int",
    )
    hit = F.col("text") == "latest_assembly_versions/"
    assert [r.source_url for r in crawl.bases(links).collect()] == ["https://h/bacteria/Esch_coli/"]
    assert [r.source_url for r in crawl.groups_without(links, "source_url", hit).collect()] == ["https://h/bacteria/Other/"]
    assert sorted({r.name for r in crawl.link_names(links).collect()}) == ["Esch_coli", "Other"]
    with pytest.raises(KeyError):
        crawl.link_names(links.drop("href"))
    assert tuple(profile.distinct_counts(links, "source_url").first()) == (4, 2, 1)


def test_reconcile(spark):
    keys = ["bacteria_name", "source_url"]
    current = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("a", "2")], "bacteria_name string, source_url string")
    prior = spark.createDataFrame([("a", "1", True, 3), ("b", "1", True, 3), ("c", "1", False, 0)], "bacteria_name string, source_url string, completed boolean, expected int")
    found = spark.createDataFrame([("a", "1", 3), ("b", "1", 2)], "bacteria_name string, source_url string, n_files int")
    got = {(r.bacteria_name, r.source_url): r.action for r in crawl.reconcile(current, prior, found, keys).collect()}
    assert got == {("a", "1"): "reuse", ("b", "1"): "clear_and_reprocess", ("c", "1"): "clear_and_reprocess", ("d", "1"): "process", ("a", "2"): "process"}
    made = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1"), ("z", "9")], "bacteria_name string, source_url string")
    assert {(r.bacteria_name, r.n_summaries, r.in_input) for r in crawl.one_summary(current, made, keys).collect()} == {("b", 2, True), ("c", 0, True), ("d", 0, True), ("a", 0, True), ("z", 1, False)}


def test_violations(spark):
    base = dict(bacteria_name="a", source_url="u", latest_assembly_versions_available=True, discovered_version_count=1, downloaded_file_count=1, download_completed=True, versions=[("v", "l")], status="success", error_message=None)
    cases = [{}, {"status": "failed"}, {"status": "done"}, {"downloaded_file_count": -1}, {"bacteria_name": ""}, {"versions": [("v", None)]}]
    df = spark.createDataFrame([tuple((base | c).values()) for c in cases], ddl("crawl_summary"))
    assert [r.violations for r in crawl.summary_violations(df).collect()] == ["", "failed_without_message", "status", "counts", "bacteria_name", "versions"]


def test_traverse(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("b", "c"), ("x", "y")], "parent string, child string")
    assert dict(crawl.traverse(edges, spark.createDataFrame([("r",)], "n string")).collect()) == {"r": 0, "a": 1, "b": 2, "c": 3}


def test_traverse_deep(spark):
    """All depths are reached; a bound that is given and hit is an error."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(66)], "parent long, child long")
    root = spark.createDataFrame([(0,)], "n long")
    assert sorted(map(tuple, crawl.traverse(chain, root).collect())) == [(i, i) for i in range(67)]
    with pytest.raises(ValueError, match="levels"):
        crawl.traverse(chain, root, most=2)
    assert crawl.traverse(chain.where("parent < 2"), root, most=2).count() == 3


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k":"x","v":1}\n{"k":"y","v":1}\n')
    args = (spark, str(tmp_path / "in"), "k string, v int", str(tmp_path / "out"), str(tmp_path / "check"))
    assert append_new(*args) == 2
    assert append_new(*args) == 0
    (tmp_path / "in/b.json").write_text('{"k":"x","v":2}\n')
    assert append_new(*args) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    upsert_latest(spark, str(tmp_path / "in"), "k string, v int", str(tmp_path / "last"), str(tmp_path / "check2"), ["k"], "v")
    (tmp_path / "in/c.json").write_text('{"k":"y","v":5}\n')
    upsert_latest(spark, str(tmp_path / "in"), "k string, v int", str(tmp_path / "last"), str(tmp_path / "check2"), ["k"], "v")
    assert dict(read_latest(spark, str(tmp_path / "last"), "k string, v int").collect()) == {"x": 2, "y": 5}
    # A version without its mark, as a stopped batch leaves it, is not read.
    spark.createDataFrame([("x", 99)], "k string, v int").write.parquet(str(tmp_path / "last/v000000000007"))
    assert dict(read_latest(spark, str(tmp_path / "last"), "k string, v int").collect()) == {"x": 2, "y": 5}
    assert read_latest(spark, str(tmp_path / "none"), "k string, v int").count() == 0


def test_rewrite_stopped(spark, tmp_path):
    """Stopped between its renames, rewrite() has left the old table aside; it is put back."""
    from seqweft.sources import files

    path = str(tmp_path / "t")
    spark.range(3).write.json(path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    files.recover(spark, path)
    assert spark.read.schema("id long").json(path).count() == 3
    files.rewrite(spark.range(5), path)
    assert spark.read.schema("id long").json(path).count() == 5 and not (tmp_path / "t.old").exists()


def test_policies_reach_tokens(spark, tmp_path):
    """Both residue policies change the run's token tables."""
    from seqweft.plans.corpus_profile import run
    from seqweft.plans.run import RunConfig

    folder = tmp_path / "in/GCA_1"
    folder.mkdir(parents=True)
    (folder / "protein.faa").write_text(">a\nMKVXAC\n>b\n" + "MKVAC" * 3000 + "U\n")
    size = {}
    for mode, rare in (("keep", "keep"), ("replace_with_unk", "keep"), ("drop", "keep"), ("keep", "drop"), ("keep", "replace_with_unk"), ("keep", "normalize")):
        out = f"{tmp_path}/{mode}-{rare}"
        run(spark, RunConfig(str(tmp_path / "in"), out, strategies=("single",), ambiguous_residue_mode=mode, rare_residue_policy=rare))
        row = spark.read.parquet(f"{out}/raw/tokenization_summary.parquet").first()
        size[mode, rare] = (row.vocabulary_size, row.n_tokens)
        assert spark.read.parquet(f"{out}/raw/recommendation.parquet").first().recommended == "single/fixed"
    # X and U are both rare here.
    assert size == {
        ("keep", "keep"): (7, 15007), ("replace_with_unk", "keep"): (6, 15007), ("drop", "keep"): (0, 0), ("keep", "drop"): (0, 0),
        ("keep", "replace_with_unk"): (6, 15007), ("keep", "normalize"): (6, 15007),
    }


def test_ranked(spark):
    assert dedupe.ranked(spark.range(20), ["id"], 6).first().id == 6
    assert dedupe.ranked(spark.range(3), ["id"], 6).count() == 0


PAGES = {
    "https://h/A/": '<pre><a href="../">Parent Directory</a><a href="latest_assembly_versions/">latest_assembly_versions/</a><a href="x.txt">x.txt</a></pre>',
    "https://h/A/latest_assembly_versions/": '<pre><a href="GCA_1/">GCA_1/</a></pre>',
    "https://h/A/latest_assembly_versions/GCA_1/": '<pre><a href="protein.faa.gz">protein.faa.gz</a></pre>',
}
INDEX = '<html><pre><a href="../">Parent Directory</a><a href="A/">A/</a><a href="B/">B/</a></pre></html>'


def test_crawl_chain(spark, tmp_path):
    """Index to version trees over fixture pages; a second run adds nothing and only tries what failed."""
    from seqweft.plans.crawl_chain import run
    from seqweft.sources.fetch import FetchError

    pages = dict(PAGES)

    def page(url):
        if url not in pages:
            raise FetchError("gone", 404)
        return pages[url]

    index = spark.createDataFrame([("https://h/", INDEX)], "url string, html string")
    first = run(spark, index, page, str(tmp_path))
    assert first == {"bacteria_tree": 1, "bacteria_tree_failed": 1, "latest_assembly_tree": 1, "assembly_version_tree": 1, "assembly_version_tree_failed": 0}
    assert set(run(spark, index, page, str(tmp_path)).values()) == {0, 1}
    tree = spark.read.json(str(tmp_path / "assembly_version_tree")).collect()
    assert [[(d.dir_name, d.source_url) for d in r.sub_dirs] for r in tree] == [[("protein.faa.gz", "https://h/A/latest_assembly_versions/GCA_1/protein.faa.gz")]]
    lost = spark.read.json(str(tmp_path / "files_warning")).collect()
    assert {(r.source_url, r.http_status, r.status) for r in lost} == {("https://h/B/", 404, "failed")} and len(lost) == 2


def test_files(spark, tmp_path):
    from seqweft.sources import files

    for name in ("a/x/1", "a/2", "b/3"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("t")
    root = str(tmp_path / "root")
    assert dict(files.count_files(spark, root).collect()) == {"a": 2, "b": 1}
    assert [files.has_consistent_output(spark, p, n) for p, n in ((root + "/a", 2), (root + "/a", 3), (root + "/none", 0))] == [True, False, False]
    files.clear_output(spark, root + "/a")
    files.ensure_directory(spark, root + "/c")
    assert sorted(p.name for p in (tmp_path / "root").iterdir()) == ["b", "c"]
    df = spark.createDataFrame([("u1", "done"), ("u2", "failed")], "source_url string, status string")
    df.write.json(str(tmp_path / "t"))
    kept = spark.read.schema(df.schema).json(str(tmp_path / "t")).where("status = 'done'")
    files.rewrite(kept, str(tmp_path / "t"))
    assert rows_of(spark.read.schema(df.schema).json(str(tmp_path / "t"))) == [("u1", "done")]


def test_summary_rows(spark):
    targets = spark.createDataFrame([("a", "1", "available"), ("b", "2", "unavailable"), ("c", "3", "available")], "bacteria_name string, source_url string, availability string")
    versions = spark.createDataFrame([("1", "v2", "l2", 2, True), ("1", "v1", "l1", 1, True), ("3", "v", "l", 1, False)], "source_url string, version_url string, version_label string, n_files int, complete boolean")
    got = crawl.summary_rows(targets, versions)
    assert {r.bacteria_name: (r.status, r.discovered_version_count, r.downloaded_file_count, r.download_completed) for r in got.collect()} == {"a": ("success", 2, 3, True), "b": ("skipped", 0, 0, False), "c": ("failed", 1, 1, False)}
    assert {r.violations for r in crawl.summary_violations(got).collect()} == {""}

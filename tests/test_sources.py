import pytest
from pyspark.sql import functions as F

from seqweft.operators import profile
from seqweft.plans.corpus_profile import run
from seqweft.plans.run import Manifest, RunConfig
from seqweft.sources import fasta, fetch, jsonl, listing

F1 = ">WP_1.1 alpha kinase [Escherichia coli]\nMKV\nX*\n>WP_2.1\nMKV\n>WP_3.1 beta  [org] [strain\nmkV\n>WP_4.1 empty one [x]\n>WP_5.1 gamma >delta [y]\r\nAC\r\nD E\r\n"
LISTING = '<pre><a href="../">Parent Directory</a>\n<a href="GCA_1.1/">GCA_1.1/</a>\n<a href="notes.txt">notes.txt</a>\n<a href="/abs/">abs/</a>\n<a href="">blank</a>\n<a href="x/"> </a></pre>'
BASE = "https://ex.org/g/sp/"


def put(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def test_fasta(spark, tmp_path):
    got = fasta.read_fasta(spark, put(tmp_path, {"GCA_000001.1/protein.faa": F1}))
    rows = {r.sequence_id: r for r in got.records.collect()}
    assert {k: (v.sequence, v.sequence_length, v.ambiguous_residues, v.functional_annotations, v.assembly_id) for k, v in rows.items()} == {
        "WP_1.1": ("MKVX*", 5, "*X", "alpha kinase", "GCA_000001.1"),
        "WP_2.1": ("MKV", 3, "", "", "GCA_000001.1"),
        "WP_3.1": ("mkV", 3, "km", "beta", "GCA_000001.1"),
        "WP_5.1": ("ACDE", 4, "", "gamma >delta", "GCA_000001.1"),
    }
    assert [(r.issue_type, r.record_identifier) for r in got.issues.collect()] == [("empty_sequence", "WP_4.1")]
    assert [tuple(r) for r in profile.length_histogram(got.records).collect()] == [(3, 2), (4, 1), (5, 1)]
    assert profile.issue_summary(got.issues).first().n == 1


def test_discovery_and_errors(spark, tmp_path):
    one = ">a b\nMK\n"
    root = put(tmp_path, {"GCA_a.b/protein.faa": one, "GCA_a/protein.faa": "junk\n" + one, "GCA_c/other.faa": one, "GCA_e/protein.faa": b">x\nM\xff\n>y\nMK\n", "x/GCA_d/protein.faa": one})
    assert [r.file_path.split("/")[-2] for r in fasta.discover(spark, root).collect()] == ["GCA_a", "GCA_a.b", "GCA_e", "GCA_d"]
    got = fasta.read_fasta(spark, root, file_path=True)
    assert sorted(r.assembly_id for r in got.records.collect()) == ["GCA_a", "GCA_a.b", "GCA_d"]
    assert sorted((r.issue_type, r.assembly_id) for r in got.issues.collect()) == [("malformed_record", "GCA_a"), ("read_error", "GCA_e")]
    assert sorted(r.assembly_id for r in fasta.read_fasta(spark, root, 2).records.collect()) == ["GCA_a", "GCA_a.b"]
    with pytest.raises(ValueError, match="sample"):
        fasta.read_fasta(spark, root, 0)
    with pytest.raises(FileNotFoundError):
        fasta.read_fasta(spark, root + "/none")
    with pytest.raises(NotADirectoryError):
        fasta.read_fasta(spark, root + "/GCA_a/protein.faa")
    empty = fasta.read_fasta(spark, put(tmp_path / "e", {"GCA/protein.faa": ">a\n"}))
    with pytest.raises(RuntimeError, match="no record"):
        fasta.corpus_to_parquet(empty, str(tmp_path / "corpus"))


def test_profile_run(spark, tmp_path):
    root = put(tmp_path / "in", {"GCA_1/protein.faa": F1, "GCA_2/protein.faa": ">z\nMKVLL\n"})
    manifest = run(spark, RunConfig(root, str(tmp_path / "out"), strategies=("single", "3-mer", "bpe"), bpe_sizes=(30,)))
    manifest.write(str(tmp_path / "m" / "manifest.json"))
    assert {a["storage_format"] for a in manifest.artifacts} == {"parquet", "csv"}
    assert spark.read.parquet(str(tmp_path / "out/raw/tokenization_summary.parquet")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/deduplicated/protein_corpus.parquet")).count() == 5


def test_config_and_manifest(tmp_path):
    for bad in ({"strategies": ("7-mer",)}, {"sample": 0}, {"ambiguous_residue_mode": "x"}, {"data_root": ""}, {"max_length": 0}):
        with pytest.raises(ValueError):
            RunConfig(**({"data_root": "a", "output_root": "b"} | bad))
    m = Manifest({})
    with pytest.raises(ValueError):
        m.write(str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        m.add("a", "poster", "parquet", "p")
    m.add("a", "figure", "svg", "p")


def test_listing(spark):
    pages = spark.createDataFrame([(BASE, LISTING), ("https://ex.org/n/", "<p>no list</p>"), ("https://ex.org/z/", None)], "url string, html string")
    want = [("GCA_1.1/", BASE + "GCA_1.1/", True), ("notes.txt", BASE + "notes.txt", False), ("abs/", "https://ex.org/abs/", True)]
    for find in (listing.links, listing.exact_links):
        assert [(r.label, r.abs_url, r.is_directory) for r in find(pages).orderBy("pos").collect()] == want
    names = [r.bacteria_name for r in listing.directory_rows(pages.where(F.col("url") == BASE)).collect()]
    assert names == ["GCA_1.1", "notes.txt", "abs", ""]
    with pytest.raises(Exception, match="no <pre>"):
        listing.directory_rows(pages.where("html like '<p>%'")).collect()
    got = {r.base_url: r for r in listing.latest_listing(pages).collect()}
    assert (got[BASE].ok, got[BASE].assemblies) == (True, ["GCA_1.1", "abs"])
    assert (got["https://ex.org/n/"].ok, got["https://ex.org/n/"].error) == (False, "no_pre_tag")
    assert got["https://ex.org/z/"].error == "not_fetched"
    with pytest.raises(ValueError, match="rule"):
        listing.links(pages, rule="none")


def test_latest_listing_keeps_pages_apart(spark):
    page = '<pre><a href="{0}/">{0}/</a><a href="n.txt">n.txt</a></pre><pre><a href="z/">z/</a></pre>'.format
    rows = [("https://h/a", page("x")), ("https://h/a", page("y")), ("https://h/a/", page("w")), ("https://h/a", None), (None, page("v"))]
    got = listing.latest_listing(spark.createDataFrame(rows, "url string, html string")).collect()
    want = [("https://h/a", True, ["x"]), ("https://h/a", True, ["y"]), ("https://h/a/", True, ["w"]), ("https://h/a", False, []), (None, True, ["v"])]
    assert sorted(((r.base_url, r.ok, r.assemblies) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.latest_url for r in got} == {"https://h/a/latest_assembly_versions/", None}


def test_fetch(spark):
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise fetch.FetchError("busy", 503)
        return "page"

    assert fetch.with_retry(flaky, "u", sleep=lambda s: None) == "page" and len(tries) == 3
    with pytest.raises(fetch.FetchError):
        fetch.with_retry(lambda u: (_ for _ in ()).throw(fetch.FetchError("gone", 404)), "u", sleep=lambda s: None)

    def once(url):
        if "bad" in url:
            raise fetch.FetchError("no", 404)
        return f"<pre>{url}</pre>"

    rows = spark.createDataFrame([("a",), ("bad",), (None,)], "source_url string")
    got = {r.url: (r.html, r.http_status, r.error_code) for r in fetch.fetch_pages(rows, once).collect()}
    assert got == {"a": ("<pre>a</pre>", None, None), "bad": (None, 404, "-"), None: (None, None, "-")}
    assert [fetch.linear(2), 2.25 <= fetch.exponential(2) <= 2.5] == [2.0, True]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a":1}\n\n  \n{bad\n{"a":2}\n')
    got = jsonl.validate_jsonl(spark, str(path))
    assert (got["valid"], got["line"]) == (False, 4)
    path.write_text('{"a":1}\r\n\n  \n{"a":2}\n')
    assert jsonl.validate_jsonl(spark, str(path)) == {"valid": True, "rows": 2}
    assert sorted(r.a for r in jsonl.read_jsonl(spark, str(path), "a int").collect()) == [1, 2]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "a int", ignore_missing=True).count() == 0
    df = spark.createDataFrame([(1, None)], "a int, b string")
    jsonl.write_jsonl(df, str(tmp_path / "o"), "errorifexists")
    with pytest.raises(Exception, match="exist"):
        jsonl.write_jsonl(df, str(tmp_path / "o"), "errorifexists")
    jsonl.write_jsonl(df, str(tmp_path / "o"), "append")
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ['{"a":1,"b":null}'] * 2


def test_input_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('bacteria_name,url\nA,https://h/a\n"B, c",https://h/b\n')
    assert [tuple(r) for r in jsonl.read_input_csv(spark, str(path)).orderBy("row_index").collect()] == [("A", "https://h/a", 1), ("B, c", "https://h/b", 2)]
    for bad in ("A,https://h/a\n,https://h/b\n", "A,u\nB,\n", "A,u\nB,u,x\n"):
        path.write_text("bacteria_name,url\n" + bad)
        with pytest.raises(ValueError, match="row 2"):
            jsonl.read_input_csv(spark, str(path))


def test_preview(spark, tmp_path):
    jsonl.write_preview(spark.range(500).select(F.col("id")), str(tmp_path / "p"), ["id"], 100)
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 100


def test_get_retries(spark):
    """What fails on a real socket gets its code, and those worth another try get one."""
    import socket
    import threading
    import urllib.error

    server = socket.create_server(("127.0.0.1", 0))
    url, calls = f"http://127.0.0.1:{server.getsockname()[1]}/", []

    def serve():
        for reply in (None, b"HTTP/1.1 503 busy\r\nContent-Length: 0\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\npage"):
            c, _ = server.accept()
            calls.append(c.recv(1000))
            if reply:
                c.sendall(reply)
            c.close()

    thread = threading.Thread(target=serve)
    thread.start()
    assert fetch.with_retry(fetch.get, url, sleep=lambda s: None) == "page" and len(calls) == 3
    thread.join()
    quiet = socket.create_server(("127.0.0.1", 0))
    with pytest.raises(fetch.FetchError) as e:
        fetch.get(f"http://127.0.0.1:{quiet.getsockname()[1]}/", timeout=0.2)
    assert e.value.code == "ETIMEDOUT"
    for reason, code in ((TimeoutError(), "ETIMEDOUT"), (ConnectionResetError(), "ECONNRESET"), (socket.gaierror(socket.EAI_AGAIN, "again"), "EAI_AGAIN"), (ConnectionRefusedError(), "-"), ("text", "-")):
        assert fetch.error_code(urllib.error.URLError(reason)) == code
    with pytest.raises(fetch.FetchError):
        fetch.get("not a url")


def test_numbered_blocks(spark, tmp_path):
    """Lines are numbered over many blocks of one file."""
    path = tmp_path / "many.jsonl"
    path.write_text("".join(f'{{"n":{i}}}\r\n' for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = jsonl.numbered_lines(spark, str(path))
        assert lines.select("block").distinct().count() > 5
        assert lines.where('value <> concat(\'{"n":\', line, "}")').count() == 0 and lines.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_links_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text('source_url,text,href,abs_url,name\nhttps://h/,"a, b",x/,https://h/x/,x\n')
    assert [tuple(r) for r in jsonl.read_links_csv(spark, str(tmp_path / "l.csv")).collect()] == [("https://h/", "a, b", "x/", "https://h/x/", "x")]


def test_command_line(spark, tmp_path, monkeypatch):
    """The exit code says whether the run ended well."""
    from seqweft import __main__ as command

    monkeypatch.setattr("seqweft.session.get_session", lambda *a, **k: spark)
    root = put(tmp_path / "in", {"GCA_1/protein.faa": F1})
    assert command.main(["corpus", root, str(tmp_path / "out"), "--manifest", str(tmp_path / "m.json"), "--strategies", "single"]) == 0
    assert (tmp_path / "m.json").exists()
    assert command.main(["corpus", str(tmp_path / "none"), str(tmp_path / "out")]) == 1


def test_shared_folder(monkeypatch):
    """Without a shared folder a cluster's session is refused; a local one gets a folder."""
    from types import SimpleNamespace

    from seqweft import session

    conf = {}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(fake)
    fake.sparkContext.master = "local[2]"
    assert session.shared_dir(fake).startswith("file://") and session.shared_dir(fake) == conf["spark.checkpoint.dir"]

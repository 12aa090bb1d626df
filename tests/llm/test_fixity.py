import gzip
import hashlib

from pyspark.sql import functions as F

from seqweft.llm import fixity
from seqweft.session import stored

SCHEMA = "page_id long, url string, html string"


def pages(spark, n=100):
    rows = [(i, f"https://h/{i}", "<p>é" + "x" * (i % 7) + "</p>") for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None), (3, "https://h/3", "<p>é" + "xxx</p>"), (200, "u", "y" * 100_000)], SCHEMA)


def plain(r):
    body = (r.html or "").encode()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if r.page_id is None else r.page_id}>\r\nWARC-Target-URI: {r.url or ''}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def written(spark, p, tmp_path, name="first"):
    return fixity.write_archives(fixity.placed(p), f"file://{tmp_path}/{name}")


def test_records(spark, tmp_path):
    """What is read back is what was written; files hold the members in order, and are WARC to a plain reader."""
    p = pages(spark)
    index = written(spark, p, tmp_path)
    got = fixity.read_back(index).collect()
    assert sorted((r.length, r.record_sha256) for r in got) == sorted((len(plain(r)), hashlib.sha256(plain(r)).hexdigest()) for r in p.collect())
    for a in {r.archive for r in got}:
        end = 0
        for n, r in enumerate(sorted((r for r in got if r.archive == a), key=lambda r: r.ordinal)):
            assert (r.ordinal, r.offset) == (n, end)
            end += r.length
    files = {r.file for r in index.collect()}
    whole = b"".join(gzip.decompress(open(f.removeprefix("file://"), "rb").read()) for f in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: resource") == len(got) and len(whole) == sum(r.length for r in got)


def brute_tree(records, fanout, levels):
    level = {(r.archive, r.ordinal): hashlib.sha256(f"{r.offset}|{r.length}|{r.record_sha256}".encode()).hexdigest() for r in records}
    out = {(a, 0, n): h for (a, n), h in level.items()}
    for up in range(1, levels + 1):
        parents = {}
        for (a, n), h in sorted(level.items()):
            parents.setdefault((a, n // fanout), []).append(f"{n}:{h}")
        level = {k: hashlib.sha256("|".join(v).encode()).hexdigest() for k, v in parents.items()}
        out |= {(a, up, n): h for (a, n), h in level.items()}
    return out


def test_tree_and_audit(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(fixity, "ARCHIVE_RECORDS", 40)
    left = stored(fixity.read_back(written(spark, pages(spark), tmp_path)), "left")
    tree = fixity.tree(left, 3, 5)
    assert {(r.archive, r.level, r.node): r.hash for r in tree.collect()} == brute_tree(left.collect(), 3, 5)
    assert fixity.audit(tree, tree, 3, 5).count() == 0
    last = left.agg(F.max("ordinal")).first()[0]
    hurt = left.where((F.col("archive") != 0) | (F.col("ordinal") != last)).withColumn("record_sha256", F.when((F.col("archive") == 1) & (F.col("ordinal") == 2), "x").otherwise(F.col("record_sha256")))
    hurt = hurt.withColumn("offset", F.col("offset") + F.when((F.col("archive") == 2) & (F.col("ordinal") == 0), 1).otherwise(0))
    extra = left.where("archive = 0").orderBy(F.desc("ordinal")).limit(1).withColumn("ordinal", F.lit(500).cast("long"))
    got = {(r.archive, r.ordinal, r.status) for r in fixity.audit(tree, fixity.tree(hurt.unionByName(extra), 3, 6).where("level <= 5"), 3, 5).collect()}
    want = {(1, 2, "corrupt"), (2, 0, "moved"), (0, 500, "extra")}
    if left.where(f"archive = 0 and ordinal = {last}").count():
        want.add((0, last, "missing"))
    assert got == want


def test_query(spark, tmp_path):
    p = pages(spark, 400)
    p.write.parquet(str(tmp_path / "pages.parquet"))
    got = fixity.op6_warc_fixity(spark, str(tmp_path)).collect()
    want = [r.page_id for r in p.collect() if r.page_id is not None and r.page_id % 61 == 7]
    assert sorted(r.page_id for r in got) == sorted(want) and {r.status for r in got} == {"corrupt"}


def test_damaged_file(spark, tmp_path, monkeypatch):
    """Bytes changed in, and cut off, a replica's real files are found by the records that hold them."""
    monkeypatch.setattr(fixity, "ARCHIVE_RECORDS", 40)
    first = written(spark, pages(spark, 120), tmp_path)
    second = fixity.replicate(first, f"file://{tmp_path}/second")
    a = fixity.tree(fixity.read_back(first))
    assert fixity.audit(a, fixity.tree(fixity.read_back(second))).count() == 0
    rows = sorted(second.collect(), key=lambda r: (r.archive, r.ordinal))
    hit, cut = rows[3], rows[-1]
    path = hit.file.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[hit.at + hit.size // 2] ^= 1
    open(path, "wb").write(raw)
    path = cut.file.removeprefix("file://")
    open(path, "r+b").truncate(cut.at + cut.size - 4)
    got = {(r.archive, r.ordinal, r.status) for r in fixity.audit(a, fixity.tree(fixity.read_back(second))).collect()}
    assert got == {(hit.archive, hit.ordinal, "corrupt"), (cut.archive, cut.ordinal, "corrupt")}


def test_edges(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    assert fixity.op6_warc_fixity(spark, str(tmp_path)).count() == 0
    same = spark.range(3000).selectExpr("cast(1 as bigint) as page_id", "'u' as url", "'h' as html", "'x' as key", "1 as n")
    got = written(spark, same, tmp_path)
    assert got.count() == 3000 and got.groupBy("archive").count().agg(F.max("count")).first()[0] < 2500
    assert got.select("archive", "ordinal").distinct().count() == 3000

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from seqweft.functions import text as X
from seqweft.functions import urls as U


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("header", "annotation", "segments", "malformed"),
    [
        ("WP_1.1 alpha kinase [Escherichia coli]", "alpha kinase", ["Escherichia coli"], False),
        ("WP_2.1", "", [], False),
        ("WP_3.1 beta  [org] [strain", "beta", [], True),
        ("WP_5.1 gamma >delta [y]", "gamma >delta", ["y"], False),
        ("a  b", "b", [], False),
        ("a\tb c", "c", [], False),
        ("x ] y [ z ]", "] y", ["z"], False),
        ("", "", [], True),
    ],
)
def test_headers(spark, header, annotation, segments, malformed):
    assert one(spark, X.functional_annotation(F.col("h")), h=header) == annotation
    got = one(spark, X.header_fields(F.col("h")), h=header)
    assert (got.annotations, got.malformed) == (segments, malformed)


def test_header_by_spaces(spark):
    cut = {h: tuple(one(spark, X.header_fields(F.col("h"), spaces=True), h=h)) for h in ("D  [a\t]", "D\tx y [ a ]", "D", "D [a", "", None)}
    assert cut == {"D  [a\t]": ("D", " [a\t]", ["a\t"], False), "D\tx y [ a ]": ("D\tx", "y [ a ]", ["a"], False), "D": ("D", "", [], False), "D [a": ("D", "[a", [], True), "": ("", "", [], True), None: (None, None, None, None)}
    assert tuple(one(spark, X.header_fields(F.col("h")), h="D  [a\t]")) == ("D", "[a\t]", ["a"], False)


@pytest.mark.parametrize(("seq", "want"), [("MKVX*", "*X"), ("MKV", ""), ("mkV", "km"), ("A-A-", "-"), ("", "")])
def test_ambiguous(spark, seq, want):
    assert one(spark, X.ambiguous_residues(F.col("s")), s=seq) == want


@pytest.mark.parametrize(("name", "want"), [("  A:b  c__d* ", "A_b_c_d"), ("***", "unnamed_bacteria"), (None, "unnamed_bacteria"), ("ok", "ok")])
def test_safe_name(spark, name, want):
    assert one(spark, X.safe_name(F.col("s")), s=name) == want
    assert one(spark, X.safe_name(X.safe_name(F.col("s"))), s=name) == want


def test_strip_and_slashes(spark):
    assert one(spark, X.strip(F.col("s")), s="  a\t\n") == "a"
    assert one(spark, X.without_one_slash(F.col("s")), s="a//") == "a/"
    assert one(spark, X.without_slashes(F.col("s")), s="a//") == "a"
    assert one(spark, X.name_in_url(F.col("s")), s="https://h/bacteria/x/bacteria/Esch_coli/") == "Esch_coli"
    assert one(spark, X.path_tail(F.col("s")), s="https://h/bacteria/a/b") == "a/b"
    assert one(spark, X.path_tail(F.col("s")), s="https://h/a") == "https://h/a"
    assert one(spark, X.between(F.col("s"), "<pre>", "</pre>"), s="x<pre>y</pre>z") == "y"
    with pytest.raises(Exception, match="no <pre>"):
        one(spark, X.between(F.col("s"), "<pre>", "</pre>"), s="nothing")


BASES = ["https://ex.org/g/sp/", "https://ex.org/g/sp", "https://ex.org", "http://a.b/c/d;p?q#f"]
HREFS = ["GCA_1.1/", "notes.txt", "/abs/", "../", "../../x", "./y/./z", "", "?q=1", "#f", "//other.org/p", "https://z.org/k", "a/../b", "x?y=../z", "mailto:a@b.c", ".", ".."]


def test_resolve_like_urljoin(spark):
    rows = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "b string, h string")
    got = {(r.b, r.h): r.u for r in rows.select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("u")).collect()}
    odd = {("https://ex.org", "?q=1"): "https://ex.org/?q=1", ("http://a.b/c/d;p?q#f", ""): "http://a.b/c/d;p?q"}  # as browsers do
    assert got == {k: odd.get(k, urljoin(*k)) for k in got}


def test_urls(spark):
    for u in ("https://h/b/X", "https://h/b/X/"):
        assert one(spark, U.latest_url(F.col("u")), u=u) == "https://h/b/X/latest_assembly_versions/"
    local = U.local_path(F.col("r"), F.col("f"), F.lit("out"))
    assert one(spark, local, r="https://h/r/l/", f="https://h/r/l/a/b.gz") == "out/a/b.gz"
    assert one(spark, local, r="https://h/r/l/", f="https://h/z/b.gz") == "out/b.gz"
    assert one(spark, local, r="https://h/r/l/", f="https://h/r/l/../b.gz") == "out/b.gz"
    assert one(spark, local, r="https://h/r/l", f="https://h/r/lx/b.gz") == "out/b.gz"
    assert one(spark, local, r="https://h/r/l", f="https://h/r/l/x/b.gz") == "out/x/b.gz"
    assert one(spark, U.parent_name(F.col("u")), u="file:///x/GCA%201+2/protein.faa") == "GCA 1+2"

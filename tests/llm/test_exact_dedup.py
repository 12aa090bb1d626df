import hashlib

from seqweft.llm import exact_dedup


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_groups(docs):
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(docs.collect())
    assert len({r.text_sha256 for r in got}) == sum(r.kept for r in got)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keep_first(docs, odd_docs):
    for d in (docs, odd_docs):
        got = exact_dedup.keep_first(d)
        assert got.columns == d.columns
        kept = got.collect()
        assert sorted((r.text or "") for r in kept) == sorted({r.text or "" for r in docs.collect()})
        assert {r.doc_id for r in kept} == {2, 4, None, 5, 6, 7, 8, 9, 10}


def test_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.keep_first(no_docs).count() == 0


def test_large_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text of many copies', concat('text ', id)) as text")
    got = exact_dedup.exact_groups(df)
    assert got.where("kept").count() == 2001
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000


def test_same_prefix_and_length(spark):
    """Texts that differ after the prefix only are told apart by the full hash."""
    a = "p" * 400
    df = spark.createDataFrame([(1, a + "x"), (2, a + "y"), (3, a + "x")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(df).collect()} == {(1, 3), (2, 2), (3, 3)}


def test_twin(spark, docs, oracle, tmp_path):
    """The SQL twin agrees on repeated rows and null ids."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    part = tmp_path / "one"
    part.mkdir()
    docs.toPandas().to_parquet(part / "documents.parquet")
    oracle(spark, exact_dedup.op2_exact_dedup, exact_dedup.OP2_SQL, str(part))


def test_length_prunes(spark):
    """A length of its own is never a suspect; a shared length with another prefix isn't either."""
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "cc"), (4, "dd"), (5, "dd"), (6, None), (7, "")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.suspects(df).where("__suspect").collect()} == {4, 5, 6, 7}

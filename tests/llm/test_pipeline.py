import hashlib
import struct

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark, odd_docs, docs):
    """Each stage on a small table with odd rows: columns, rows kept, order, and ids against the library."""
    import tiktoken

    from seqweft.llm import byte_bpe
    from seqweft.session import stored

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    for d in (docs, odd_docs):
        frames = [d]
        for _, stage in pipeline.STAGES:
            frames.append(stored(stage(spark, frames[-1], SF), "stage"))
        assert all(f.columns == d.columns for f in frames[1:-1])
        counts = [f.count() for f in frames]
        assert counts == [12, 8, 6, 5, 5, 5]
        assert sorted(map(repr, frames[3].collect())) == sorted(map(repr, frames[4].collect()))
        path, pattern = byte_bpe.production()
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(byte_bpe.read_ranks(path))}, special_tokens={})
        texts = {r.doc_id: r.text for r in frames[4].collect()}
        for r in frames[5].collect():
            ids = library.encode_ordinary(texts[r.doc_id])
            assert bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids)
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark):
    """Every text with a language, once, but near copies; held against plain forms of exact and near dedup."""
    from test_simhash import brute_kept

    got = pipeline.run(spark, SF)
    docs = pipeline.identify_language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    last = {}
    for r in docs.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in got.collect()) == sorted(brute_kept([(d, t) for t, d in last.items()]))


def test_empty(spark, no_docs):
    d = no_docs
    for _, stage in pipeline.STAGES:
        d = stage(spark, d, SF)
        assert d.count() == 0


def test_language_decisions(spark):
    """A missing language is filled in, a contradicted one rejected, and what has no letters goes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = docs.where("length(text) > 2000")
    german = long.where("lang = 'de'").orderBy("doc_id").first()
    odd = spark.createDataFrame([(-1, german.text, None, "s", 1), (-2, german.text, "en", "s", 1), (-4, "A.", "es", "s", 1), (-5, "123", "en", "s", 1)], docs.schema)
    kept = {r.doc_id: r.lang for r in pipeline.identify_language(spark, docs.unionByName(odd), SF).where("doc_id < 0").collect()}
    assert kept.pop(-4, "es") == "es"
    assert kept == {-1: "de"}


def test_unlabelled(spark, docs):
    """Without a label nothing can be learned, and every text with letters still stays."""
    from pyspark.sql import functions as F

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = pipeline.identify_language(spark, bare, SF)
    assert kept.count() == pipeline.identify_language(spark, docs, SF).count() == 8

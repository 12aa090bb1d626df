import math
import zlib
from collections import Counter

import numpy as np
import pytest

from seqweft.llm import lm_score as L


def tables(texts, order):
    x, _ = L._joined(texts, order)
    code = L._codes(x, order)
    code = code[(code & 0xFF) != L.START]
    return L.Tables([np.unique(code & ((1 << 8 * (j + 1)) - 1), return_counts=True) for j in range(order + 1)])


TRAIN = [b"abracadabra", b"the cat sat on the mat", b"", b"the dog", "é ü".encode()]
ASK = [b"abracad", b"the mat", b"", b"zzz\x00", "ü the é".encode(), b"q" * 50]


@pytest.mark.parametrize("order", [0, 1, 2, 5])
def test_like_the_trie(order):
    trie = L.Trie(order)
    for t in TRAIN:
        trie.train(t)
    got = tables(TRAIN, order).score(ASK)
    assert np.allclose(got, [trie.score(t) for t in ASK])
    assert np.allclose(tables([], order).score(ASK), [L.Trie(order).score(t) for t in ASK])


def test_probabilities_sum_to_one():
    trie = L.Trie(3)
    for t in TRAIN:
        trie.train(t)
    for context in (b"the", b"zzz", b" ca", bytes([L.START] * 3)):
        assert abs(sum(10 ** trie.log10(context, s) for s in range(256)) - 1) < 1e-9


def test_adaptive():
    trie = L.Trie(3)
    repeated = trie.score(b"abcabcabcabcabc", adaptive=True)
    assert repeated > L.Trie(3).score(b"abcdefghijklmno", adaptive=True)
    assert L.Trie(3).score(b"a", adaptive=True) < 0


def test_windows(monkeypatch):
    texts = [b"the cat sat " * 9, b"", b"x" * 40]
    t = tables(TRAIN, 3)
    whole = t.score(texts)
    for w in (1, 7, 33):
        monkeypatch.setattr(L, "WINDOW", w)
        assert np.allclose(t.score(texts), whole)


def test_count_flush(monkeypatch):
    """Small bounds give the same counts in more rows."""
    import pyarrow as pa

    texts = ["the cat sat on the mat"] * 5 + ["", "a b c", "x" * 500]

    def counts():
        got = Counter()
        for b in L._count(iter([pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2])], names=["t"]) for i in range(0, len(texts), 2)]), 2):
            for r in b.to_pylist():
                got[r["code"], r["word"]] += r["n"]
        return got

    want = counts()
    monkeypatch.setattr(L, "PENDING", 16)
    monkeypatch.setattr(L, "FLUSH", 4)
    assert counts() == want
    assert want[None, b""] == len(texts) and want[None, b"the"] == 10


def test_node_bound(spark):
    df = spark.createDataFrame([(t.decode(),) for t in TRAIN], "text string")
    trie = L.build(L.gather(df, 3), 3, nodes=12)
    assert all(len(c) <= 12 for c, _ in trie)
    t = L.Tables(trie)
    for context in (b"the", b"\xfe\xfe\xfe"):
        base = int.from_bytes(context, "big") << 8
        assert abs((10 ** t.log10(np.arange(base, base + 256))).sum() - 1) < 1e-9


def test_scores(spark, docs, odd_docs, no_docs, monkeypatch):
    rows = docs.collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 7 == 2
    train = [(r.text or "").encode().lower() for r in rows if not held(r)]
    words = Counter(w for t in train for w in [*t.split(), b""])
    total, size = sum(words.values()), math.log10(sum(words.values()) + len(words) + 1)
    model = tables(train, 3)
    want = []
    for r in rows:
        raw = (r.text or "").encode().lower()
        k = [*raw.split(), b""]
        want.append((r.doc_id, len(k), sum(words[w] > 0 for w in k), total, round(sum(math.log10(words[w] + 1) - size for w in k), 4), round(float(model.score([raw])[0]), 4)))
    from seqweft.llm.common import doc_hash

    for d, top in ((docs, L.TOP_WORDS), (odd_docs, 2)):  # with two broadcast words, the join counts the rest
        monkeypatch.setattr(L, "TOP_WORDS", top)
        got = L.score(d, d.where(doc_hash() % 7 != 2), ["doc_id"], order=3).collect()
        assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got], key=repr) == sorted(want, key=repr)
    assert L.score(no_docs, no_docs, ["doc_id"], order=2).count() == 0
    alone = L.score(docs, no_docs, ["doc_id"], order=2).where("doc_id = 3").first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (1, 0, 0, 0.0) and abs(alone.score + math.log10(256)) < 1e-9


@pytest.mark.parametrize("nodes", [0, 5, 40])
def test_whole_model_beyond_the_broadcast(spark, monkeypatch, nodes):
    """With few codes broadcast, the scores are still those of the whole trie."""
    monkeypatch.setattr(L, "NODES", nodes)
    train, ask = (spark.createDataFrame([(i, t.decode()) for i, t in enumerate(ts)], "doc_id long, text string") for ts in (TRAIN, [*ASK, *TRAIN]))
    for order in (2, 5):
        got = {r.doc_id: r.score for r in L.score(ask, train, ["doc_id"], order=order).collect()}
        assert np.allclose([got[i] for i in range(len(got))], tables(TRAIN, order).score([*ASK, *TRAIN]))


def test_adaptive_rows(docs):
    small = docs.where("length(text) < 1000 or text is null")
    got = L.adaptive(small, ["doc_id"], order=2).collect()
    assert len(got) == small.count() and all(r.score < 0 for r in got)

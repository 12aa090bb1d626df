import hashlib
import struct

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seqweft.llm import byte_bpe

PATH, PATTERN = byte_bpe.production()


@pytest.fixture(scope="module")
def both():
    vocab = byte_bpe.read_ranks(PATH)
    coder = byte_bpe.ByteBpe(vocab, byte_bpe.serialise_model(vocab), PATTERN)
    return coder, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(vocab)}, special_tokens={})


def same(both, text):
    coder, library = both
    ids = coder.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(both, text):
    same(both, text)


def test_texts(both):
    for text in ("", " ", "<|endoftext|>", "a" * 30_000, "\x00\x01", "日本語 🎉", "don't  stop\n\n now", "ß" * 999, "▁x", "Ā ā Ă"):
        same(both, text)


def test_cache_bound(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 500)
    monkeypatch.setattr(byte_bpe, "CACHED_CHARS", 3)
    for n in range(50):
        same(both, f"word{n} other{n * n}")


def test_query(docs, odd_docs, no_docs, both):
    for d in (docs, odd_docs):
        got = byte_bpe.tokenise(d, PATH, PATTERN, ["doc_id", "text"], digests=True).collect()
        assert len(got) == 12
        for r in got:
            ids = both[1].encode_ordinary(r.text or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.tokenise(no_docs, PATH, PATTERN, ["doc_id"]).count() == 0
    plain = byte_bpe.tokenise(docs, PATH, PATTERN, ["text"]).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and len(r.token_ids) == 4 * r.n_tokens for r in plain)


def test_gaps(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="gaps"):
        byte_bpe.read_ranks(str(tmp_path / "r"))

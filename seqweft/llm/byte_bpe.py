"""Byte-level BPE: a sentencepiece model written straight from a rank file.

Each byte is one character of its own (U+0100 plus its value), so a vocabulary entry becomes a piece of as many characters as it has
bytes; its score is its negative rank and the normalisation is the identity. sentencepiece then merges the pair of
best score first, leftmost among equals, which is the merge order of the ranks. A pre-token that is an entry itself is
that entry. Decoding maps ids to pieces and pieces to bytes.

Null text counts as empty and gives no ids; repeated rows each give a row; an empty table gives an empty table. Texts are
taken whole at any length: a worker holds one text and its ids at a time, and a cache of short pre-tokens of about CACHE_BYTES.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import body, small_batches, table

CACHE_BYTES, CACHED_CHARS = 64 << 20, 64
BYTE_CHARS = [chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file in rank order; ranks must run from 0 without a gap."""
    with open(path, "rb") as lines:
        ranks = sorted((int(rank), base64.b64decode(entry)) for entry, rank in map(bytes.split, lines))
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [entry for _, entry in ranks]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(vocab: list[bytes]) -> bytes:
    """The vocabulary as a sentencepiece BPE model; the unknown piece, which the format needs, has the id after the last."""
    pieces = [_field(1, "".join(BYTE_CHARS[b] for b in entry).encode()) + _field(2, float(-rank)) for rank, entry in enumerate(vocab)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    bpe, no_special = 2, -1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(vocab)) + b"".join(_field(n, no_special) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes and decodes with one model; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocab: list[bytes], model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.vocab = vocab
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.entries = {entry: struct.pack("<I", rank) for rank, entry in enumerate(vocab)}
        self.inverse = [bytes(ord(c) - 0x100 for c in self.model.id_to_piece(i)) for i in range(len(vocab))]
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        tokens = self.split(text)
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        cache, entries, long = self.cache, self.entries, {}
        rest = []
        for token in set(tokens).difference(cache):
            if (known := entries.get(raw := token.encode())) is not None:
                cache[token] = known
                self.held += 150 + 4 * len(token)
            else:
                rest.append((token, raw))
        if rest:
            mapped = ["".join([BYTE_CHARS[b] for b in raw]) for _, raw in rest]
            for (token, _), ids in zip(rest, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
                coded = struct.pack(f"<{len(ids)}I", *ids)
                if len(token) > CACHED_CHARS:
                    long[token] = coded
                else:
                    cache[token] = coded
                    self.held += 150 + 4 * (len(token) + len(ids))
        if long:
            return b"".join([cache[t] if t in cache else long[t] for t in tokens])
        return b"".join([cache[token] for token in tokens])

    def decode(self, ids: bytes) -> bytes:
        inverse = self.inverse
        return b"".join([inverse[i] for i in memoryview(ids).cast("I")])


SCHEMA = "token_ids binary, n_tokens long, decoded binary"


def tokenise(docs: DataFrame, vocab_path: str, pattern: str, keep: list[str], digests: bool = False, ids: bool = False, text: str = "text") -> DataFrame:
    """The columns in keep, then token_ids (little-endian uint32), n_tokens and the decoded bytes.

    With digests, ids_sha256 and decoded_sha256 in lowercase hex stand in place of token_ids and decoded; with ids too, token_ids
    is there beside them. The driver reads the rank file; executors get vocabulary and model by broadcast, whose size is the file's.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocab = read_ranks(vocab_path)
    shared = spark.sparkContext.broadcast((vocab, serialise_model(vocab)))
    made = [("ids_sha256" if digests else "token_ids", "string" if digests else "binary"), ("n_tokens", "long"), ("decoded_sha256" if digests else "decoded", "string" if digests else "binary")]
    if digests and ids:
        made.insert(2, ("token_ids", "binary"))
    arrow = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(*shared.value, pattern)
        finish = (lambda raw: hashlib.sha256(raw).hexdigest()) if digests else bytes
        for batch in batches:
            found: dict[str, list] = {name: [] for name, _ in made}
            for value in batch.column(0):
                coded = coder.encode(value.as_py())
                row = {made[0][0]: finish(coded), "n_tokens": len(coded) // 4, made[-1][0]: finish(coder.decode(coded))}
                for name, _ in made:
                    found[name].append(row.get(name, coded))
            columns = [pa.array(found[name], arrow[kind]) for name, kind in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], schema=pa.schema([*list(batch.schema)[1:], *[(name, arrow[kind]) for name, kind in made]]))

    kept = docs.select(body(text).alias("__body"), *[F.col(c) for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]]
    return kept.mapInArrow(run, ", ".join([*fields, *[f"{name} {kind}" for name, kind in made]]))


def production() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return tokenise(table(spark, sf_dir, "documents"), *production(), keep=["doc_id"], digests=True)

import hashlib
import zlib

import pytest

from seqweft.llm import media
from seqweft.session import shared_path


def test_png():
    for raw in (b"", b"a", b"a" * 64, b"b" * 65, bytes(range(256)) * 9):
        png = media.to_png(raw)
        assert media.from_png(png) == (media.pad(raw), len(raw)) and png == media.to_png(raw)
        assert media.features(media.pad(raw)).startswith("h=")
    png = bytearray(media.to_png(b"text"))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


def test_query(spark, docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        path = shared_path(spark, "media")
        media.store(d, path)
        for size in (media.RANGE_BYTES, 100):  # small ranges: a member for each, and empty ones
            read = media.load(spark, path, size)
            got = read.select("doc_id", "media", "error").mapInArrow(media.digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()
            want = []
            for r in d.collect():
                p = media.pad((r.text or "").encode())
                want.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
            assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
            assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    path = shared_path(spark, "media")
    media.store(no_docs, path)
    assert media.load(spark, path).count() == 0


def test_damage(spark, docs, tmp_path):
    """A damaged member is a row with its error; its neighbours are read."""
    path = tmp_path / "m"
    media.store(docs.coalesce(1), str(path))
    archive = next(path.glob("*.zip"))
    rows = media.load(spark, str(path)).orderBy("offset").collect()
    raw = bytearray(archive.read_bytes())
    raw[rows[2].offset + 80] ^= 255
    archive.write_bytes(raw)
    again = media.load(spark, str(path)).orderBy("offset").collect()
    assert [bool(r.error) for r in again] == [i == 2 for i in range(len(rows))]
    assert all(a.media == b.media for i, (a, b) in enumerate(zip(rows, again, strict=True)) if i != 2)
    with pytest.raises(Exception, match="damaged"):
        media.load(spark, str(path)).mapInArrow(media.digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").count()


def test_retry(tmp_path):
    """A member is tried again on a newly opened file."""
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", b"payload")
    info = zipfile.ZipFile(tmp_path / "a.zip").infolist()[0]
    tries = []

    def opened():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("gone")
        return open(tmp_path / "a.zip", "rb")

    assert media.read_member(opened, info.header_offset, info.file_size, info.CRC, wait=0) == b"payload" and len(tries) == 3
    with pytest.raises(OSError, match="gone"):
        media.read_member(lambda: (_ for _ in ()).throw(OSError("gone")), 0, 1, 1, 2, 0)


def test_uncommitted(spark, docs, tmp_path):
    """Archives that were not committed are not read."""
    media.store(docs, str(tmp_path / "m"))
    n = media.load(spark, str(tmp_path / "m")).count()
    first = next((tmp_path / "m").glob("*.zip"))
    (tmp_path / "m" / "part-lost.zip").write_bytes(first.read_bytes())
    assert media.load(spark, str(tmp_path / "m")).count() == n == 12

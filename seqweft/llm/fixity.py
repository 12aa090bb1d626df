"""WARC and a Merkle fixity audit of replicas.

placed() makes each page a record (header, blank line, payload, two line ends) and deals the records to archives of about
ARCHIVE_RECORDS; write_archives() writes each archive as one file with a gzip member a record, and gives an index of what it
wrote: in each archive a record has an ordinal and an offset in the uncompressed stream, and a member's place in its file.
replicate() copies the members of such files to another folder. read_back() reads members by their ranges in the files and hashes what it
gets; a member that can't be read or unpacked gets the hash of its damaged bytes. The audit sees these hashes alone.

tree(): leaves hash records; a node of level l + 1 covers FANOUT
neighbours of level l, so an ordered range of offsets, and hashes their hashes; the root is the level with one node.
audit() compares the roots of two replicas, and descends only where hashes differ: each level's children are joined with
the mismatches above. It ends at the records that differ, are missing in either replica, or lie at other offsets.

Groups are bounded: an archive's records and a node's children. Identical rows are told apart by a copy number before
they are dealt, so copies of any number spread over the archives. Payloads go through one shuffle, by archive. Files have names of their own
for each attempt, and only those in the index are read, so lost or repeated tasks do no harm. Null columns count as empty in
the record and as themselves in the keys. An empty table has no archives, and an audit of it no rows. Other columns are not read.
Paths are URIs of any file system that pyarrow.fs opens, in a folder that all executors share.
"""

from __future__ import annotations

import gzip
import hashlib
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import small_batches, table
from seqweft.session import shared_path, stored

ARCHIVE_RECORDS, FANOUT, DAMAGE_MODULUS, DAMAGE_REST = 1024, 8, 61, 7
LEVELS = 5  # enough for 8^5 records in an archive, thirty times the mean
EOL = "\r\n"
BUCKETS, TASK_BYTES, TRIES = 1 << 18, 64 << 20, 4


def record(url: Column, payload: Column, record_id: Column) -> Column:
    """A WARC/1.1 resource record in UTF-8. It has no date: fixity needs equal bytes for equal pages."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    lines = ["WARC/1.1", "WARC-Type: resource", "WARC-Record-ID: <urn:page:{id}>", "WARC-Target-URI: {url}", "Content-Type: text/html; charset=utf-8", "Content-Length: {n}", "", ""]
    parts: list[Column] = []
    for piece in EOL.join(lines).replace("{", "\0{").replace("}", "}\0").split("\0"):
        parts.append({"{id}": F.coalesce(record_id.cast("string"), F.lit("")), "{url}": F.coalesce(url, F.lit("")), "{n}": F.octet_length(body).cast("string")}.get(piece, F.lit(piece)))
    return F.concat(F.concat(*parts).cast("binary"), body, F.lit(EOL * 2).cast("binary"))


def placed(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """archive, key, copy (a row's number among equal ones), record and its hash, in no order."""
    rows = pages.select(F.col(key).alias("key"), record(F.col(url), F.col(payload), F.col(key)).alias("record")).withColumn("sha", F.sha2("record", 256))
    counts = stored(rows.groupBy("key", "sha").agg(F.count("*").alias("n")), "records")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("key", "sha"), F.lit(BUCKETS)).cast("int")
    # Which rows may be repeated reaches the scan as a filter of BUCKETS rows at most; their records are aggregated, then given out n times.
    again = counts.where("n > 1").select(bucket.alias("__bucket")).distinct().withColumn("__again", F.lit(True))
    marked = rows.withColumn("__bucket", bucket).join(F.broadcast(again), "__bucket", "left")
    once = marked.where("__again is null").select("key", "sha", "record", F.lit(1).cast("long").alias("copy"))
    many = marked.where("__again").groupBy("key", "sha").agg(F.first("record").alias("record"), F.count("*").alias("n"))
    each = once.unionByName(many.select("key", "sha", "record", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")))
    mixed = F.sha2(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("")), "sha", F.col("copy").cast("string")).cast("binary"), 256)
    return each.withColumn("archive", F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long") % F.lit(max(1, -(-total // ARCHIVE_RECORDS))))


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


INDEX = [("archive", pa.int64()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]
INDEX_SQL = "archive long, ordinal long, offset long, length long, key long, file string, at long, size long"


def _by_archive(df: DataFrame, n_bytes: int, order: list) -> DataFrame:
    """df dealt to tasks by archive, as many as TASK_BYTES each take or there are cores, in order within an archive."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    return df.repartition(tasks, "archive").sortWithinPartitions("archive", *order)


def _write(batches: Iterator[pa.RecordBatch], root: str, members) -> Iterator[pa.RecordBatch]:
    """A file for each archive; members(batch) gives archive, key, the record's length, and the member's bytes."""
    fs, folder = _fs(root)
    fs.create_dir(folder, recursive=True)
    out, name, archive, ordinal, offset, at = None, "", None, 0, 0, 0
    try:
        for batch in batches:
            rows = []
            for own, key, length, member in members(batch):
                if out is None or own != archive:
                    if out is not None:
                        out.close()
                    archive, ordinal, offset, at = own, 0, 0, 0
                    name = f"{root}/{own:08d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    out = fs.open_output_stream(f"{folder}/{name.rpartition('/')[2]}", compression=None)
                out.write(member)
                rows.append((archive, ordinal, offset, length, key, name, at, len(member)))
                ordinal, offset, at = ordinal + 1, offset + length, at + len(member)
            columns = zip(*rows, strict=True) if rows else [[]] * len(INDEX)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, INDEX, strict=True)], schema=pa.schema(INDEX))
    finally:
        if out is not None:
            out.close()


def write_archives(records: DataFrame, root: str) -> DataFrame:
    """Writes what placed() gives to files in the folder root; the index is a table in the shared folder."""
    small_batches(records.sparkSession)

    def members(batch: pa.RecordBatch):
        for archive, key, raw in zip(*(batch.column(c) for c in ("archive", "key", "record")), strict=True):
            record_ = raw.as_py()
            yield archive.as_py(), key.as_py(), len(record_), gzip.compress(record_, 1, mtime=0)

    size = records.agg(F.coalesce(F.sum(F.octet_length("record")), F.lit(0))).first()[0]
    rows = _by_archive(records.select("archive", F.col("key").cast("long").alias("key"), "sha", "copy", "record"), size, ["key", "sha", "copy"])
    return stored(rows.mapInArrow(lambda it: _write(it, root, members), INDEX_SQL), "index")


class _Files:
    """Byte ranges of files, read through one open handle at a time; each further try opens the file anew."""

    def __init__(self) -> None:
        self.name, self.handle = None, None

    def read(self, uri: str, at: int, size: int, wait: float = 0.05) -> bytes:
        for n in range(TRIES):
            try:
                if self.name != uri or n:
                    fs, path = _fs(uri)
                    self.name, self.handle = uri, fs.open_input_file(path)
                self.handle.seek(at)
                raw = self.handle.read(size)
                if len(raw) < size and n < TRIES - 1:
                    raise OSError("short read")
                return raw
            except OSError:
                self.name = None
                if n == TRIES - 1:
                    raise
                time.sleep(wait * 2**n)
        raise OSError("no tries")


def replicate(index: DataFrame, root: str, hurt: Column | None = None) -> DataFrame:
    """Copies all members to files in the folder root; of those that hurt selects (by key) a byte in the middle is changed on the way."""
    small_batches(index.sparkSession)

    def members(batch: pa.RecordBatch):
        files = _Files()
        for archive, key, length, file, at, size, bad in zip(*(batch.column(c).to_pylist() for c in ("archive", "key", "length", "file", "at", "size", "bad")), strict=True):
            raw = bytearray(files.read(file, at, size))
            if bad:
                raw[len(raw) // 2] ^= 0xFF
            yield archive, key, length, bytes(raw)

    size = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    marked = index.withColumn("bad", F.coalesce(hurt, F.lit(False)) if hurt is not None else F.lit(False))
    return stored(_by_archive(marked, size, ["ordinal"]).mapInArrow(lambda it: _write(it, root, members), INDEX_SQL), "index")


def read_back(index: DataFrame) -> DataFrame:
    """archive, ordinal, offset, length, key and record_sha256 of each member of an index, from the bytes that its range holds now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in batches:
            lengths, hashes = [], []
            for file, at, size, length in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size", "length")), strict=True):
                raw = files.read(file, at, size)
                try:
                    found = gzip.decompress(raw)
                    lengths.append(len(found))
                    hashes.append(hashlib.sha256(found).hexdigest())
                except (OSError, EOFError, zlib.error):
                    lengths.append(length)
                    hashes.append(hashlib.sha256(b"damaged" + raw).hexdigest())
            kept = [batch.column(c) for c in ("archive", "ordinal", "offset")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lengths, pa.int64()), batch.column("key"), pa.array(hashes, pa.string())], names=["archive", "ordinal", "offset", "length", "key", "record_sha256"])

    size = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return _by_archive(index, size, ["at"]).mapInArrow(run, "archive long, ordinal long, offset long, length long, key long, record_sha256 string")


def tree(records: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """archive, level, node, start, end, hash: level 0 is the records; each node hashes its children in order of offset."""
    leaf = F.sha2(F.concat_ws("|", F.col("offset"), F.col("length"), "record_sha256").cast("binary"), 256)
    level = stored(records.select("archive", F.col("ordinal").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), leaf.alias("hash")), "level")
    shown = lambda df, n: df.select("archive", F.lit(n).alias("level"), "node", "start", "end", "hash")
    out = shown(level, 0)
    for n in range(1, levels + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        grouped = level.groupBy("archive", F.floor(F.col("node") / fanout).alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), children.alias("c"))
        joined = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"])), "|")
        level = stored(grouped.select("archive", "node", "start", "end", F.sha2(joined.cast("binary"), 256).alias("hash")), "level")
        out = out.unionByName(shown(level, n))  # a level is a constant of its branch, so the audit reads only the one it compares
    return out


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """archive, ordinal, start and end in either replica, compared (nodes looked at on the way down by level), and status.

    left, right: trees by archive; status is corrupt (one place, other bytes), moved, missing or extra (in the right one).
    """
    a, b = (t.select("archive", "level", "node", F.struct("start", "end", "hash").alias(side)) for t, side in ((left, "l"), (right, "r")))
    wrong = None
    for n in range(levels, -1, -1):
        x, y = (t.where(F.col("level") == n).drop("level") for t in (a, b))
        if wrong is not None:
            x, y = (t.withColumn("up", F.floor(F.col("node") / fanout)).join(wrong, ["archive", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.join(y, ["archive", "node"], "full").where(~F.col("l.hash").eqNullSafe(F.col("r.hash")))
        wrong = both.select("archive", F.col("node").alias("up"))
        if n:
            wrong = stored(wrong, "mismatch")
    place = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when((F.col("l.start") != F.col("r.start")) | (F.col("l.end") != F.col("r.end")), "moved").otherwise("corrupt")
    return both.select("archive", F.col("node").alias("ordinal"), F.col("l.start").alias("start"), F.col("l.end").alias("end"), F.col("r.start").alias("replica_start"), F.col("r.end").alias("replica_end"), place.alias("status"))


def op6_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """The pages as WARC files, and a replica in which the members of records with page_id % 61 = 7 have one byte changed.

    Both are read back from their files; start and end are places in the uncompressed archive.
    """
    first = write_archives(placed(table(spark, sf_dir, "pages")), shared_path(spark, "warc"))
    second = replicate(first, shared_path(spark, "replica"), F.col("key") % DAMAGE_MODULUS == DAMAGE_REST)
    one = stored(read_back(first), "read")
    found = audit(tree(one), tree(read_back(second)))
    named = found.join(one.select("archive", "ordinal", F.col("key").alias("page_id"), "record_sha256"), ["archive", "ordinal"], "left")
    return named.select("page_id", "archive", "ordinal", "start", "end", "replica_start", "replica_end", "status", "record_sha256")


OP6_SQL = f"""
WITH r AS (SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e
    || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS rec FROM pages, (SELECT chr(13) || chr(10) AS e)),
h AS (SELECT page_id, strlen(rec) AS length, sha256(rec) AS record_sha256, row_number() OVER (PARTITION BY page_id, sha256(rec)) AS copy FROM r),
a AS (SELECT *, ('0x' || substr(sha256(coalesce(page_id::VARCHAR, '') || '|' || record_sha256 || '|' || copy), 1, 15))::BIGINT % greatest(1, ceil(count(*) OVER () / {float(ARCHIVE_RECORDS)}))::BIGINT AS archive FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS ordinal, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, record_sha256, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM a WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, record_sha256, copy))
SELECT page_id, archive, ordinal, start, start + length AS "end", start AS replica_start, start + length AS replica_end, 'corrupt' AS status, record_sha256 FROM o WHERE page_id % {DAMAGE_MODULUS} = {DAMAGE_REST}
"""

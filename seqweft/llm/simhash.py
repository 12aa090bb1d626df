"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit j is 1 if over half of the text's shingle hashes have it. Bit j also gets a non-zero
vector v(j) of RADIUS + 1 bits. Table t, for t from 1 to 2^(RADIUS+1) - 1, keeps the bits with an odd inner product
<v(j), t>. Two fingerprints that differ in RADIUS bits or fewer agree in some table: RADIUS linear equations in
RADIUS + 1 unknowns have a solution t other than zero, and that table keeps none of the bits that differ.

near_components() takes one fingerprint of shingles. keep_representatives() takes PRINTS fingerprints of words, each word weighed by the
square root of its count: texts whose five-word shingles have a Jaccard similarity of 0.8 differ in few of these bits, where
fingerprints of shingles differ in ten. Texts are linked if one of their fingerprints differs in RADIUS bits or fewer and, so that texts
of like vocabulary do not link, one of CHECKS minima of their five-word shingles' hashes is the same (at 0.8 that fails once in
600 pairs, for unrelated texts it holds only where they share a passage).

Links are sought between distinct fingerprints only, so copies cost nothing. A bucket of up to BUCKET_ROWS fingerprints
is compared in numpy and gives one link for each member that is joined, not all pairs. In a larger bucket each member
is dealt out under every way to clear RADIUS of the bits that the table leaves open; members that meet there differ in
these bits at most and link to the smallest. Both ways lose no link, and rows grow in proportion to members.

Words are runs of anything but space and \\t\\n\\v\\f\\r, A-Z lower-cased, whole texts. Fewer than three words: one shingle of
all; none, or null text: fingerprint zero, linked like any other. Repeated rows each give a row. A component's id is its
smallest doc_id, null only if all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import body, connected_components, small_batches, table
from seqweft.session import stored

WORDS, SEED, RADIUS, BUCKET_ROWS = 3, 42, 2, 2048
PRINTS, CHECKS, CHECK_WORDS = 3, 4, 5
BUCKETS = 1 << 18
CHUNK = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64 bits as an unsigned integer."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    raw = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([of(raw[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """The columns in keep and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], schema=pa.schema([*list(batch.schema)[1:], ("fp", pa.int64())]))

    rows = docs.select(body(text).alias("__body"), *[F.col(c) for c in keep])
    return rows.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:]) + "fp long")


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each 64-bit hash (the finalizer of splitmix64, public)."""
    z = h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def word_prints(text: str, prints: int = PRINTS, checks: int = CHECKS, words: int = CHECK_WORDS) -> tuple[list[int], list[int]]:
    """Fingerprints of the words, and minima of the shingles' hashes, as signed integers; a text without words has zeros."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * prints, [0] * checks
    of = xxhash.xxh64_intdigest
    known, place = np.unique(np.fromiter(map(of, tokens), np.uint64, len(tokens)), return_inverse=True)
    weight = np.rint(np.sqrt(np.bincount(place)) * 1024)  # whole numbers, so that sums are exact in any order
    sums = np.zeros((prints, 64))
    for at in range(0, len(known), CHUNK):
        part, w = known[at : at + CHUNK], weight[at : at + CHUNK]
        for n in range(prints):
            bits = np.unpackbits(_mixed(part, n).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[n] += w @ bits
    fps = np.packbits(2 * sums > weight.sum(), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
    h, k = known[place], min(words, len(tokens))
    shingle = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        shingle = shingle * np.uint64(0xD1342543DE82EF95) + h[j : len(h) - k + 1 + j]
    least = np.array([_mixed(shingle, -1 - n).min() for n in range(checks)], np.uint64)
    return fps.view(np.int64).tolist(), least.view(np.int64).tolist()


def prints_of(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, then fps and checks, arrays of longs."""
    small_batches(docs.sparkSession)
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_prints(x.as_py()) for x in batch.column(0)]
            made = [pa.array([f[n] for f in found], longs) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], schema=pa.schema([*list(batch.schema)[1:], ("fps", longs), ("checks", longs)]))

    rows = docs.select(body(text).alias("__body"), *[F.col(c) for c in keep])
    return rows.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:]) + "fps array<long>, checks array<long>")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bits that each table keeps."""
    vectors = [1 + j % (2 ** (radius + 1) - 1) for j in range(bits)]
    return [sum(1 << j for j in range(bits) if (vectors[j] & t).bit_count() % 2) for t in range(1, 2 ** (radius + 1))]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """A forest for each bucket: a node linked to one within the radius, for all but one of each component."""
    for batch in batches:
        left, right = [], []
        for value in batch.column(0):
            nodes, fps = (value.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("node", "fp"))
            bits = fps.view(np.uint64)
            todo = np.arange(len(nodes))
            while len(todo):
                front, todo = [int(todo[0])], todo[1:]
                while front and len(todo):
                    at = front.pop()
                    close = np.bitwise_count(bits[todo] ^ bits[at]) <= radius
                    near, todo = todo[close], todo[~close]
                    front.extend(near.tolist())
                    left.append(nodes[near])
                    right.append(np.full(len(near), nodes[at]))
        a, b = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (left, right))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join the fingerprints in column fp into the components of "radius bits or fewer differ"."""
    return node_links(distinct.select(F.col("fp").alias("node"), F.lit(0).alias("part"), "fp"), radius=radius)


def node_links(rows: DataFrame, checks: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join nodes into the components of "radius bits or fewer differ in one part", and a check in common.

    rows: node, part, fp; only fingerprints of the same part are compared. checks: node, checks, each node once. Buckets are formed by
    the covering alone; then the checks divide them.
    """
    kept = masks(radius)
    keys = F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(kept)])
    dealt = rows.select("node", "part", "fp", F.explode(keys).alias("k")).select("part", "k.t", "k.key", "node", "fp")
    bucket = ["part", "t", "key"]
    sizes = stored(dealt.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = stored(dealt.join(sizes, bucket), "met")
    if checks is None:
        met = met.withColumns({"pos": F.lit(0), "col": F.lit(0).cast("long")})
        bucket = [*bucket, "pos", "col"]
    else:
        each = met.drop("n").join(checks, "node").select(*bucket, "node", "fp", F.posexplode("checks").alias("pos", "col"))
        bucket = [*bucket, "pos", "col"]
        met = stored(each.join(stored(each.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), "divided"), bucket), "checked")
    few = met.where(F.col("n") <= BUCKET_ROWS).groupBy(*bucket).agg(F.collect_list(F.struct("node", "fp")).alias("members"))
    near = few.select("members").mapInArrow(lambda it: _bucket_links(it, radius), "a long, b long")
    ways = [[_signed(sum(1 << j for j in c)) for c in combinations([j for j in range(64) if not m >> j & 1], radius)] for m in kept]
    cleared_bits = F.element_at(F.expr("array(" + ", ".join(f"array({', '.join(f'{w}L' for w in x)})" for x in ways) + ")"), F.col("t") + 1)
    many = met.where(F.col("n") > BUCKET_ROWS).repartition(F.col("fp"))
    cleared = many.select("part", "t", "pos", "col", "node", "fp", F.explode(cleared_bits).alias("c"))
    met_there = cleared.select("part", "t", "pos", "col", "c", F.col("fp").bitwiseAND(F.bitwise_not("c")).alias("rest"), "node")
    # Members that meet link to their smallest node: its minimum is joined back, so that no group is gathered.
    place = ["part", "t", "pos", "col", "c", "rest"]
    hubs = met_there.join(stored(met_there.groupBy(*place).agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "hubs"), place)
    return near.unionByName(hubs.select("a", F.col("node").alias("b")).where("a != b")).distinct()


def components(rows: DataFrame, first: Column) -> DataFrame:
    """fp, root, first and n of each distinct fingerprint in rows: first is the smallest such value, n the count of rows."""
    distinct = stored(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "distinct")
    roots = connected_components(stored(links(distinct.select("fp")), "near"))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stored(named, "named")


def word_components(rows: DataFrame, first: Column) -> DataFrame:
    """components() by words: rows have fps and checks; fp is here the hash of both, which stands for texts alike in them."""
    rows = rows.withColumn("fp", F.xxhash64("fps", "checks"))
    distinct = stored(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n"), F.first("fps").alias("fps"), F.first("checks").alias("checks")), "distinct")
    nodes = distinct.select(F.col("fp").alias("node"), F.posexplode("fps").alias("part", "fp"))
    roots = connected_components(stored(node_links(nodes, distinct.select(F.col("fp").alias("node"), "checks")), "near"))
    named = distinct.select("fp", "first", "n").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stored(named, "named")


def near_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id for each row of docs."""
    rows = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]), "fp")
    ids = components(rows, F.col("doc_id"))
    component = ids.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(ids.join(component, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component of texts near by their words, that of the smallest doc_id (nulls last); columns unchanged.

    Which rows are in a component of more than one reaches the text scan as a filter of at most BUCKETS rows; only those
    that it lets through are shuffled and held against the verdicts, the others pass.
    """
    print_ = F.xxhash64(body(text))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), print_.alias("print"))
    rows = stored(prints_of(keyed, ["doc_id", "print"]), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("print"))
    ids = word_components(rows, order)
    rows = rows.select("doc_id", "print", F.xxhash64("fps", "checks").alias("fp"))
    shared = ids.groupBy("root").agg(F.min("first").alias("win"), F.sum("n").alias("rows")).where("rows > 1")
    judged = rows.join(stored(ids.join(shared, "root").select("fp", "win"), "win"), "fp")
    verdict = stored(judged.select("doc_id", "print", (F.col("doc_id").eqNullSafe(F.col("win.doc_id")) & (F.col("print") == F.col("win.print"))).alias("__stay")).distinct(), "verdict")
    bucket = lambda i, p: F.pmod(F.xxhash64(i, p), F.lit(BUCKETS)).cast("int").alias("__bucket")
    hit = verdict.select(bucket("doc_id", "print")).distinct().withColumn("__hit", F.lit(True))
    marked = docs.withColumn("__print", print_).withColumn("__bucket", bucket(F.col(doc_id), F.col("__print"))).join(F.broadcast(hit), "__bucket", "left")
    maybe = marked.where("__hit")
    found = maybe.join(verdict, maybe[doc_id].eqNullSafe(verdict["doc_id"]) & (maybe["__print"] == verdict["print"]), "left")
    free = found.where(F.col("__stay").isNull()).select(*[maybe[c] for c in docs.columns])
    best = found.where("__stay").select(*[maybe[c] for c in docs.columns], "__print").dropDuplicates([doc_id, "__print"]).select(*docs.columns)
    return marked.where(F.col("__hit").isNull()).select(*docs.columns).unionByName(free).unionByName(best)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

import random
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from seqweft.llm import simhash


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(pairs):
    """component_id by (doc_id, fp) rows"""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(pairs)), 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2:
            parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted([(d, f, best.get(find(i))) for i, (d, f) in enumerate(pairs)], key=repr)


def test_fingerprint():
    for text in ("", " \n", "One", "one two", "A b C", "a b c d", "é ü ß x y z", "the cat " * 500):
        assert simhash.fingerprint(text) == plain(text), text


def test_spark_hash(spark):
    """The shingle hash is Spark's xxhash64 too."""
    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_covering():
    kept = simhash.masks()
    assert len(kept) == 7
    for n in (0, 1, 2):
        for bits in combinations(range(64), n):
            x = sum(1 << b for b in bits)
            assert any(not x & m for m in kept)


def _links(spark, fps):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in set(signed)], "fp long")
    return {frozenset((a % (1 << 64), b % (1 << 64))) for a, b in simhash.links(df).collect()}


def _components(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = tuple(e)
        parent[find(a)] = find(b)
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def _cluster(seed):
    r = random.Random(seed)
    fps = set()
    for _ in range(20):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            x ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3])))
            fps.add(x)
    return sorted(fps)


def test_links(spark, monkeypatch):
    for seed, most in ((1, simhash.BUCKET_ROWS), (2, 1)):  # the second has every bucket dealt out by cleared bits
        monkeypatch.setattr(simhash, "BUCKET_ROWS", most)
        fps = _cluster(seed)
        found = _links(spark, fps)
        assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, found))
        every = [frozenset(p) for p in combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 2]
        assert _components(fps, found) == _components(fps, every)


def test_components(spark, docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        got = sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_components(d).collect()], key=repr)
        assert got == brute([(r.doc_id, plain(r.text)) for r in docs.collect()])
    assert simhash.near_components(no_docs).count() == 0


def plain_mix(h, salt):
    m = (1 << 64) - 1
    z = (h + salt * 0x9E3779B97F4A7C15) & m
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
    z = (z ^ z >> 27) * 0x94D049BB133111EB & m
    return z ^ z >> 31


def plain_words(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    return [w for w in words.split(" ") if w]


def plain_prints(text):
    words = plain_words(text)
    if not words:
        return [0] * simhash.PRINTS, [0] * simhash.CHECKS
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    fps = []
    for n in range(simhash.PRINTS):
        sums = [0] * 64
        for x, c in Counter(h).items():
            for j in range(64):
                sums[j] += round(1024 * c**0.5) * (1 if plain_mix(x, n) >> j & 1 else -1)
        fps.append(sum(1 << j for j in range(64) if sums[j] > 0))
    k = min(simhash.CHECK_WORDS, len(h))
    shingles = []
    for i in range(len(h) - k + 1):
        z = 0
        for x in h[i : i + k]:
            z = (z * 0xD1342543DE82EF95 + x) % (1 << 64)
        shingles.append(z)
    return fps, [min(plain_mix(z, -1 - n) for z in shingles) for n in range(simhash.CHECKS)]


def brute_kept(rows):
    """doc_id kept of each component of linked texts"""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = [plain_prints(t) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        near = any((a ^ b).bit_count() <= 2 for a, b in zip(found[i][0], found[j][0], strict=True))
        if near and any(a == b for a, b in zip(found[i][1], found[j][1], strict=True)):
            parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted([min((d for d in g if d is not None), default=None) for g in groups.values()], key=repr)


def test_word_prints():
    for text in ("", " \n", "One", "one two", "A b C a b", "a b c d e f g a b c d", "é ü ß x y z", "the cat sat on a mat and the dog " * 40):
        fps, checks = simhash.word_prints(text)
        assert ([x % (1 << 64) for x in fps], [x % (1 << 64) for x in checks]) == plain_prints(text), text


def _near_texts(seed, n=40):
    """Texts of Zipf-like words, each with copies that have some words replaced; and unrelated texts over the same words."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    share = [1 / (n + 8) for n in range(3000)]
    draw = lambda: r.choices(words, share)[0]
    texts = []
    for _ in range(n):
        base = [draw() for _ in range(r.randint(60, 500))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = draw()
            texts.append(" ".join(copy))
    texts = sorted(set(texts))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_near_brute(spark, monkeypatch):
    """All components against brute force, with buckets compared in numpy, and dealt out by cleared bits."""
    rows = _near_texts(5, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (simhash.BUCKET_ROWS, 1):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", most)
        assert sorted([r.doc_id for r in simhash.keep_representatives(df).collect()], key=repr) == brute_kept(rows)


def test_near_recall(spark):
    """Of pairs with a five-word Jaccard similarity of 0.8 or more nine tenths fall together; unrelated texts never."""
    rows = _near_texts(11, 150)
    shingles = []
    for _, t in rows:
        w = t.split()
        shingles.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    prints = simhash.prints_of(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).withColumn("fp", F.xxhash64("fps", "checks"))
    root = {r.doc_id: r.root for r in prints.join(simhash.word_components(prints, F.col("doc_id")), "fp").select("doc_id", "root").collect()}
    caught = total = 0
    for i, j in combinations(range(len(rows)), 2):
        both = len(shingles[i] & shingles[j])
        like = both / (len(shingles[i]) + len(shingles[j]) - both)
        if like >= 0.8:
            total += 1
            caught += root[i] == root[j]
        elif not both:
            assert root[i] != root[j]
    assert total > 200 and caught / total >= 0.9, (caught, total)


def test_large_near_bucket(spark, monkeypatch):
    """Many texts alike in words and passages, more than a bucket's bound: one stays."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 50)
    df = spark.range(400).selectExpr("id as doc_id", "concat(repeat('the same words of a passage again and again ', 40), 'n', id) as text")
    assert [r.doc_id for r in simhash.keep_representatives(df).collect()] == [0]


def test_keep_representatives(spark, docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        got = simhash.keep_representatives(d)
        assert got.columns == d.columns
        want = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted([r.doc_id for r in got.collect()], key=repr) == want
    assert simhash.keep_representatives(no_docs).count() == 0


def test_equal_ids(spark):
    """Of near texts with one doc_id a single row stays; far ones with that id all stay, repeated rows once."""
    long = " ".join(f"w{n * n % 97}x" for n in range(300)) + " "
    df = spark.createDataFrame([(1, long + "a"), (1, long + "b"), (1, "quite another text with words of its own"), (1, "quite another text with words of its own"), (None, long + "c")], "doc_id long, text string")
    got = simhash.keep_representatives(df).collect()
    assert [r.doc_id for r in got] == [1, 1] and {r.text[:5] for r in got} == {"w0x w", "quite"}

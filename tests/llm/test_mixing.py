import math
from collections import Counter
from fractions import Fraction

import pytest

from seqweft.llm import mixing


def check(rows, weights, block):
    """All rows once; blocks in order; slots within release and deadline; less than one block away from the fluid share."""
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    n = Counter(r.source for r in rows)
    blocks = {s: -(-c // block) for s, c in n.items()}
    slots = {}
    for r in sorted(rows, key=lambda r: r.position):
        assert r.release <= r.slot < r.deadline
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(sum(blocks.values())))
    by_position = [r.slot for r in sorted(rows, key=lambda r: r.position)]
    assert by_position == sorted(by_position)
    had = Counter()
    for t in range(len(slots) + 1):
        low, high = 0.0, max(blocks[s] / weights[s] for s in blocks)
        for _ in range(80):
            v = (low + high) / 2
            low, high = (v, high) if sum(min(weights[s] * v, blocks[s]) for s in blocks) < t else (low, v)
        assert all(abs(had[s] - min(weights[s] * high, blocks[s])) < 1 for s in blocks)
        if t < len(slots):
            s, b = slots[t]
            assert had[s] == b
            had[s] += 1


@pytest.mark.parametrize(("sizes", "weights", "block"), [({"a": 40, "b": 25, "c": 7}, {"a": 3, "b": 2, "c": 1}, 2), ({"a": 5, "b": 90}, {"a": 7, "b": 1}, 1), ({"a": 1}, {"a": 1}, 4), ({"a": 33, "b": 33, "c": 33, "d": 1}, {"a": 5, "b": 3, "c": 11, "d": 2}, 3)])
def test_pfair(spark, sizes, weights, block):
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    wanted = spark.createDataFrame(list(weights.items()), "source string, weight long")
    got = mixing.mix(df, ["doc_id"], block=block, weights=wanted).collect()
    assert len(got) == len(rows)
    check(got, weights, block)


def test_power(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(400)], "doc_id long, source string")
    got = mixing.mix(df, ["doc_id"], block=4).collect()
    share = math.sqrt(300) + math.sqrt(100)
    check(got, {"a": round(math.sqrt(300) / share * 128), "b": round(math.sqrt(100) / share * 128)}, 4)


def test_edges(docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        got = mixing.mix(d, ["doc_id", "text"], block=2, prefix="mix_").collect()
        assert sorted(r.mix_position for r in got) == list(range(12))
    assert mixing.mix(no_docs, ["doc_id"]).count() == 0


def test_buckets(spark, monkeypatch):
    """A source over many buckets, with many rows under one id."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    df = spark.range(600).selectExpr("if(id % 2 = 0, 1, id) as doc_id", "'hot' as source")
    got = mixing.mix(df, ["doc_id"], block=8).collect()
    assert sorted(r.position for r in got) == list(range(600))
    check(got, {"hot": 128}, 8)


def edf(rows, weights, block):
    """slot of each (source, block) by a plain simulation: of the released blocks the one with the earliest deadline, then by source."""
    n = Counter(r.source for r in rows)
    blocks = {s: -(-c // block) for s, c in n.items()}
    fluid = lambda v: sum(min(weights[s] * v, Fraction(blocks[s])) for s in blocks)
    jobs = {(s, i): (math.floor(fluid(Fraction(i, weights[s]))), math.ceil(fluid(Fraction(i + 1, weights[s])))) for s in blocks for i in range(blocks[s])}
    had, out = Counter(), {}
    for t in range(sum(blocks.values())):
        d, s = min((jobs[s, had[s]][1], s) for s in blocks if had[s] < blocks[s] and jobs[s, had[s]][0] <= t)
        out[s, had[s]] = t
        had[s] += 1
    return out, jobs


def held(spark, sizes, weights, block=1):
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = mixing.mix(df, ["doc_id"], block=block, weights=spark.createDataFrame(list(weights.items()), "source string, weight long")).collect()
    slots, jobs = edf(got, weights, block)
    assert {(r.source, r.block): (r.slot, r.release, r.deadline) for r in got} == {k: (slots[k], *jobs[k]) for k in slots}
    return got


def test_halves(spark, monkeypatch):
    """Schedules by halves are the plain simulation's, down to groups of two blocks."""
    monkeypatch.setattr(mixing, "LEAF", 2)
    held(spark, {"a": 90, "b": 33, "c": 70, "d": 5}, {"a": 31, "b": 7, "c": 13, "d": 2})


def test_large_weights(spark):
    """Weights in the thousands: reduced by their divisor, or in wide rounds, less than one block from the share at any time."""
    sizes = {"a": 3000, "b": 900, "c": 500}
    check(held(spark, {"a": 300, "b": 100}, {"a": 3000, "b": 1000}), {"a": 3, "b": 1}, 1)
    check(held(spark, sizes, {"a": 3001, "b": 1000, "c": 777}), {"a": 3001, "b": 1000, "c": 777}, 1)


def test_token_counts_as_weights(spark):
    """Weights that sum to more than PRECISION keep their shares to within one part in it."""
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 = 0, 'b', 'a') as source")
    weights = spark.createDataFrame([("a", 987_654_321_987), ("b", 123_456_789_123)], "source string, weight long")
    got = mixing.mix(rows, ["doc_id"], block=1, weights=weights).collect()
    assert sorted(r.position for r in got) == list(range(4000))
    first = [r.source for r in sorted(got, key=lambda r: r.position)][:2000]
    assert abs(first.count("a") - 2000 * 987_654_321_987 / (987_654_321_987 + 123_456_789_123)) < 1.1


def test_many_sources(spark):
    """Over a thousand sources of different sizes."""
    df = spark.range(9000).selectExpr("id as doc_id", "concat('s', cast(sqrt(id * 150) as int)) as source")
    got = mixing.mix(df, ["doc_id"], block=2).select("source", "block", "slot", "release", "deadline", "position").collect()
    assert sorted(r.position for r in got) == list(range(9000))
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert len({r.source for r in got}) > 1000

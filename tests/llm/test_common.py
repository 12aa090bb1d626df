import random

from seqweft.llm.common import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


def test_components(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    some = [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(70)]
    edges = [*chain, *star, *some, (-5, -7), (7, 7), (None, 3), (3, None), (1000, 1001)]
    r.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.root for x in got} == brute(edges)


def test_none(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0

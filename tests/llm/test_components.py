import random

from cartolith.llm.components import components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_both_ways(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (5, 2), (2, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for one_task in (10_000, 0):
        assert {x.node: x.component for x in components(df, one_task=one_task).collect()} == brute([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

import random

from lakeloom.operators.components import connected_components


def expected(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def check(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in connected_components(df).collect()} == expected([(a, b) for a, b in edges if a is not None and b is not None and a != b])


def test_random_graphs(spark):
    rng = random.Random(3)
    check(spark, [(rng.randrange(200), rng.randrange(200)) for _ in range(150)])


def test_path_and_star(spark):
    check(spark, [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(900, 930)])


def test_loops_and_nulls_are_no_edges(spark):
    check(spark, [(1, 1), (None, 2), (3, None), (5, 4), (4, 5)])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

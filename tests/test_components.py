import random

from marketloom.operators.components import connected_components


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {x: find(x) for x in root}


def got(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    return {r["node"]: r["component"] for r in connected_components(df).collect()}


def test_long_chain_converges(spark):
    chain = [(i, i + 1) for i in range(100)]
    random.Random(1).shuffle(chain)
    assert got(spark, chain) == {i: 0 for i in range(101)}


def test_random_graph_nulls_loops_repeats(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)]
    pairs += pairs[:10] + [(None, 3), (4, None), (5, 5)]
    want = {k: v for k, v in brute(pairs).items()}
    assert got(spark, pairs) == want


def test_no_edges(spark):
    assert got(spark, []) == {}

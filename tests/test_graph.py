import random

from granary.operators.graph import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components_of_chain_star_and_random(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    edges += [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    edges += [(5, 5), (None, 7), (900, None), (0, 1), (1, 0)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0

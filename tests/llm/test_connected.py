import random

from broadloom.llm.components import connected_components


def test_paths_stars_loops_and_repeats(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] * 2
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = [tuple(r) for r in connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root)
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []

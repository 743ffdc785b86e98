"""Connected components against union-find, whole and in steps."""

import random

from filequarry.llm.common import written
from filequarry.llm.components import components, merged


def expected(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def frame(spark, links):
    return written(spark.createDataFrame(links, "a long, b long"), "test-links")


def got(df):
    rows = [tuple(r) for r in df.select("id", "component").collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_components(spark):
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1030)]
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + chain
    links = [(a, b) for a, b in links if a != b]
    assert got(components(frame(spark, links))) == expected(links)


def test_further_links(spark):
    first = [(9, 5), (5, 7), (20, 21), (30, 31), (40, 41)]
    for more in ([], [(21, 9), (60, 61), (31, 60)], [(5, 9)], [(2, 41), (41, 30)]):
        part = written(components(frame(spark, first)), "test-part")
        assert got(merged(part, frame(spark, more))) == expected(first + more)


def test_no_links(spark):
    part = written(components(frame(spark, [])), "test-part")
    assert got(part) == {}
    assert got(merged(part, frame(spark, [(3, 1)]))) == {1: 1, 3: 1}

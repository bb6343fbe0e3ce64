"""What connected components and saved tables leave on disk and shuffle."""

import os
import random

from fleetlens.llm import components
from fleetlens.llm.components import connected_components
from fleetlens.llm.storage import leaves_its_result, save


def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return sorted((x, find(x)) for x in root if find(x) != x)


def test_components_of_chains_stars_and_nodes_with_many_edges(spark, monkeypatch):
    monkeypatch.setattr(components, "MANY", 20)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(5, i) for i in range(2000, 2200)]
    edges += [(9000, i) for i in range(8000, 8100)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)]
    rng.shuffle(edges)
    table = spark.createDataFrame([(a, b) for a, b in edges], "a long, b long").repartition(7)
    found = sorted((r.node, r.root) for r in connected_components(table).collect())
    assert found == roots([(a, b) for a, b in edges if a != b])


def test_stars_need_no_round(spark, monkeypatch):
    def fails(_):
        raise AssertionError("a round ran")

    monkeypatch.setattr(components, "_with_least", fails)
    table = spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "a long, b long").coalesce(1)
    assert sorted(map(tuple, connected_components(table).collect())) == [(2, 1), (3, 1), (5, 4)]


def test_only_tables_of_the_result_stay(spark):
    kept, gone = [], []

    @leaves_its_result
    def inner(df):
        gone.append(save(df, "first"))
        kept.append(save(df.selectExpr("id + 1 AS id"), "second"))
        return kept[0]

    given = save(spark.range(3), "given")
    found = inner(given)
    assert sorted(r.id for r in found.collect()) == [1, 2, 3] and given.count() == 3
    there = [os.path.exists(f.removeprefix("file://")) for df in (kept[0], gone[0]) for f in df.inputFiles()[:1]]
    assert there == [True, False]

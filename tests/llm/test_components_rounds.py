"""Edges of many tasks that need no round of stars."""

import random

from fleetlens.llm import components
from fleetlens.llm.components import connected_components

from test_disk import roots


def test_few_edges_of_many_tasks_need_no_round(spark, monkeypatch):
    def fails(_):
        raise AssertionError("a round ran")

    monkeypatch.setattr(components, "_with_least", fails)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(700 + i % 3, i) for i in range(600, 700)]
    random.Random(1).shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(9)
    assert sorted(map(tuple, connected_components(table).collect())) == roots(edges)

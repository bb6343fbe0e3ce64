"""Recall of the permutation index beside a large group of exact copies."""

import numpy as np

from fleetlens.llm.permutation import distinct_directions, permutation_neighbours
from pyspark.sql import functions as F


def test_recall_beside_a_hot_group_of_copies(spark):
    chance = np.random.default_rng(4)
    x = chance.normal(size=(15_000, 64)).round(4).astype(np.float32)
    hot = np.arange(len(x)) % 3 == 1
    x[hot] = x[1]
    table = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"
    )
    k, found = 20, {}
    for r in permutation_neighbours(table, F.col("vec_id") % 150 < 2).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    x = x.astype(np.float64)
    hits, total = {True: 0, False: 0}, {True: 0, False: 0}
    asked = [i for i in range(len(x)) if i % 150 < 2]
    assert sorted(found) == asked
    for i in asked:
        score = (x * x[i]).sum(axis=1)
        score[i] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:k].tolist()
        got = [found[i][r] for r in range(1, k + 1)]
        hits[bool(hot[i])] += len(set(got) & set(want))
        total[bool(hot[i])] += k
    print("recall in the group", hits[True] / total[True], "of others", hits[False] / total[False])
    assert hits[True] == total[True] and hits[False] >= 0.9 * total[False]


def test_pivots_are_different_directions():
    x = np.array([[1.0, 0], [2, 0], [0, 3], [1, 0], [-1, 0], [1, 1]])
    assert distinct_directions(x, 3).tolist() == [[1, 0], [0, 1], [-1, 0]]

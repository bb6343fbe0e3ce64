"""Exact top-k inner products by the threshold algorithm.

A block of rows is held as one list per dimension, sorted by value.  A query walks the lists of its
dimensions from their best ends in step; every row met is scored in full; no row unmet can score
more than the sum of what the lists have come down to.  It stops when that bound is below its k-th
best score: an equal bound could still hide a smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import save
from fleetlens.llm.vectors import best_of, blockwise_best, ids_of, matrix, usable_vectors

#: Depth of the first step; every later step doubles the depth.
FIRST_STEP = 4


def threshold_search(k: int):
    """Search of one block, see blockwise_best."""

    def run(own: pa.Table, asked: pa.Table):
        x, q = matrix(own["vector"]), matrix(asked["vector"])
        ids, n, qn = ids_of(own), own["n"].to_numpy(), asked["n"].to_numpy()
        lists = np.argsort(x, axis=0, kind="stable")
        values = np.take_along_axis(x, lists, axis=0)
        rows = len(x)
        out_q, out_r, out_s = [], [], []
        for i, ask in enumerate(q):
            up, down = np.flatnonzero(ask > 0), np.flatnonzero(ask < 0)
            met = n == qn[i]
            at = np.zeros(0, np.int64)
            score = np.zeros(0)
            depth, step = 0, FIRST_STEP
            while True:
                until = min(rows, depth + step)
                if len(up) or len(down):
                    new = np.concatenate(
                        [lists[rows - until : rows - depth][:, up].ravel(), lists[depth:until][:, down].ravel()]
                    )
                else:  # all scores are 0
                    new = np.arange(rows)
                fresh = np.zeros(rows, dtype=bool)
                fresh[new] = True
                new = np.flatnonzero(fresh & ~met)
                met[new] = True
                # Whole numbers below 2^53: sums in doubles are exact.
                at, score = np.concatenate([at, new]), np.concatenate([score, x[new] @ ask])
                best = best_of(score, ids[at], k)
                at, score = at[best], score[best]
                depth, step = until, step * 2
                if depth >= rows or met.all():
                    break
                bound = ask[up] @ values[rows - depth, up] + ask[down] @ values[depth - 1, down]
                if len(score) >= k and bound < score[-1]:
                    break
            out_q.append(np.full(len(at), i))
            out_r.append(at)
            out_s.append(score)
        return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s).astype(np.int64)

    return run


def exact_top_k(table: DataFrame, asks: Column, k: int = 5, steps: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows by inner product of floor(steps * x).

    Queries are the rows where ``asks`` holds; candidates all rows but the query's own.  Null
    vectors and those with null or non-finite components take no part, zero vectors do; repeated
    rows are rows of their own; ties go to the smaller vec_id.  An empty table gives no rows.  Sums
    must stay below 2^53, far beyond vectors of ordinary components.  Other columns play no part.
    """
    vectors = usable_vectors(table, zero=True)
    whole = vectors.withColumn("vector", F.expr(f"transform(vector, x -> double(floor({steps} * x)))"))
    whole = save(whole.select("vec_id", "vector", "n"), "whole")
    return blockwise_best(whole, whole.where(asks), threshold_search(k), k, "long")

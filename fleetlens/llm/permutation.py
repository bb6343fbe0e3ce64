"""Nearest neighbours by a permutation index.

Every vector is told by the order of its nearest pivots.  It is posted under each of them with the
place it gives it.  A query reads the posting lists of its own nearest pivots and ranks rows by the
footrule distance of the two orders, a pivot outside an order counting as one place behind it.  The
nearest tenth of every block, with all ties at its end, is ranked again by exact inner product.
Equal vectors are searched as one and then told apart by (score, vec_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import save
from fleetlens.llm.vectors import best_of, blockwise_best, matrix, usable_vectors

#: Pivots: a sample of this many directions, whatever the size of the table.
PIVOTS = 256
#: Places of an order.
PLACES = 64
#: Share of a block that is ranked again, and the least number.
RERANK, LEAST_RERANK = 0.1, 1000


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """``vector``, a number ``n`` and ``copies``, the ``most`` rows (vec_id, n) of the smallest vec_id.

    Map tasks keep ``most`` rows of a vector each, so a vector with many copies is no hot group.
    """
    copies = Window.partitionBy("vector").orderBy("vec_id", "n")
    first = vectors.withColumn("_i", F.row_number().over(copies)).where(F.col("_i") <= most)
    each = first.groupBy("vector").agg(F.collect_list(F.struct("vec_id", "n")).alias("copies"))
    return each.select("vector", F.xxhash64("vector").alias("n"), "copies")


def distinct_directions(vectors: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors of the first ``most`` different directions."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    _, first = np.unique(unit.round(9) + 0.0, axis=0, return_index=True)
    return unit[np.sort(first)[:most]]


def pivot_orders(vectors: DataFrame, unit: np.ndarray, places: int) -> DataFrame:
    """``vectors`` with ``near``, the numbers of the nearest pivots in order, as 16-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column("vector")]))
            order = np.argsort(-(x @ unit.T), axis=1, kind="stable")[:, :places].astype("<u2")
            yield batch.append_column("near", pa.array([o.tobytes() for o in order], pa.binary()))

    return vectors.mapInArrow(run, vectors.withColumn("near", F.lit(b"")).schema)


def footrule_search(pivots: int, places: int, k: int, rerank: float, least: int):
    """Search of one block of distinct vectors, see blockwise_best."""

    def run(own: pa.Table, asked: pa.Table):
        x, q = matrix(own["vector"]), matrix(asked["vector"])
        qn, lists = asked["n"].to_numpy(), own["copies"].combine_chunks()
        edges, copies = lists.offsets.to_numpy(), lists.values
        vec_id, n = copies.field("vec_id"), copies.field("n").to_numpy(zero_copy_only=False)
        ids = vec_id.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        near = np.frombuffer(b"".join(own["near"].to_pylist()), "<u2").reshape(len(x), places)
        # Posting lists of the block: rows by pivot, each with the places left behind it.
        by_pivot = np.argsort(near.ravel(), kind="stable")
        edge = np.searchsorted(near.ravel()[by_pivot], np.arange(pivots + 1)).tolist()
        row, left = by_pivot // places, (places - by_pivot % places).astype(np.int32)
        length = np.linalg.norm(x, axis=1)
        scale = None if np.ptp(length) < 1e-6 * length.max() else length / length.max()
        many = min(len(x), max(least, k + 1, int(rerank * len(x))))
        out_q, out_r, out_s, out_c = [], [], [], []
        for i, order in enumerate(asked["near"].to_pylist()):
            # Footrule = constant - 2 * sum over shared pivots of the lesser number of places left.
            shared = np.zeros(len(x), dtype=np.int32)
            for place, pivot in enumerate(np.frombuffer(order, "<u2").tolist()):
                part = slice(edge[pivot], edge[pivot + 1])
                shared[row[part]] += np.minimum(left[part], places - place)
            rank = shared if scale is None else shared * scale  # longer vectors score higher
            # Whatever ties with the last of the ``many`` is ranked again as well.
            least_rank = np.partition(rank, len(x) - many)[len(x) - many]
            at = np.flatnonzero(rank >= least_rank)
            score = (x[at] * q[i]).sum(axis=1)
            # One more than asked for: the query's own vector may have no other copy.
            if len(at) > k + 1:
                good = score >= np.partition(score, len(at) - k - 1)[len(at) - k - 1]
                at, score = at[good], score[good]
            times = edges[at + 1] - edges[at]
            copy = np.repeat(edges[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
            at, score = np.repeat(at, times), np.repeat(score, times)
            other = n[copy] != qn[i]
            at, score, copy = at[other], score[other], copy[other]
            best = best_of(score, ids[copy], k)
            out_q.append(np.full(len(best), i))
            out_r.append(at[best])
            out_s.append(score[best])
            out_c.append(copy[best])
        found = vec_id.take(pa.array(np.concatenate(out_c)))
        return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s), found

    return run


def permutation_neighbours(
    table: DataFrame,
    asks: Column,
    k: int = 20,
    pivots: int = PIVOTS,
    places: int = PLACES,
    rerank: float = RERANK,
    least: int = LEAST_RERANK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` nearest rows by inner product.

    Queries are the rows where ``asks`` holds; candidates all rows but the query's own.  Null and
    zero vectors and those with null or non-finite components take no part; repeated rows are rows
    of their own; a null vec_id never asks under a condition on vec_id.  No more than ``k`` rows or
    an empty table are no special case.  Other columns play no part.
    """
    vectors = usable_vectors(table, zero=False)
    apart = save(distinct_vectors(vectors, k + 1), "distinct")
    # More than enough, as some may have one direction.
    sample = apart.orderBy("n").limit(4 * pivots).select("vector").collect()
    if not sample:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    units = distinct_directions(np.array([r.vector for r in sample], dtype=np.float64), pivots)
    places = min(places, len(units))
    index = save(pivot_orders(apart, units, places), "orders")
    asked = save(pivot_orders(vectors.where(asks).select("vec_id", "vector", "n"), units, places), "asked")
    search = footrule_search(len(units), places, k, rerank, least)
    return blockwise_best(index, asked, search, k, "double")

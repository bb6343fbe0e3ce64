"""Query blocks against row blocks of a vector table, and the merge of the blocks' best."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import save

#: Rows of a block: what one task holds of either side.
BLOCK = 8192


def usable_vectors(table: DataFrame, zero: bool) -> DataFrame:
    """``n, vec_id, vector`` of the vectors that take part; ``n`` numbers the rows.

    Null vectors and those with null or non-finite components are left out, with ``zero=False``
    zero vectors too.  Vectors must be of one length: the commonest, the longer one of two.
    """
    fine = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = table.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")
    ).where("vector IS NOT NULL AND size(vector) > 0").where(fine)
    if not zero:
        rows = rows.where("exists(vector, x -> x <> 0)")
    rows = save(rows.withColumn("n", F.monotonically_increasing_id()), "vectors")
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    found = size.first()
    return rows.where(F.size("vector") == (found.d if found else 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = pa.concat_arrays(column.chunks).flatten() if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blockwise_best(
    rows: DataFrame,
    queries: DataFrame,
    search: Callable[[pa.Table, pa.Table], tuple],
    k: int,
    score_type: str,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of each query.

    ``search`` gets a block of rows and a block of queries and returns (query position, row
    position, score) of up to ``k`` rows for each query, and their vec_ids where a row stands for
    several.  A task holds one block of each side,
    whatever the tables' sizes; ties go to the smaller vec_id, a null one first.
    """
    row_blocks = max(1, -(-rows.count() // BLOCK))
    query_blocks = max(1, -(-queries.count() // BLOCK))

    def blocks(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.withColumn("rb", F.pmod("n", F.lit(row_blocks)).cast("int")).withColumn(
        "qb", blocks(query_blocks)
    )
    right = queries.withColumn(
        "qb", F.pmod(F.xxhash64("n"), F.lit(query_blocks)).cast("int")
    ).withColumn("rb", blocks(row_blocks))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        if own.num_rows and asked.num_rows:
            q, r, score, *ids = search(own, asked)
        else:
            q = r = score = np.zeros(0, np.int64)
            ids = [pa.array([], pa.int64())]
        return pa.table(
            {
                "qn": asked["n"].take(pa.array(q)),
                "query_id": asked["vec_id"].take(pa.array(q)),
                "vec_id": ids[0] if ids else own["vec_id"].take(pa.array(r)),
                "score": pa.array(score, pa.float64() if score_type == "double" else pa.int64()),
            }
        )

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(
        run, f"qn long, query_id long, vec_id long, score {score_type}"
    )
    best = Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def ids_of(table: pa.Table) -> np.ndarray:
    """vec_ids as numbers to break ties by; null comes first."""
    return table["vec_id"].fill_null(-(2**63)).to_numpy()

"""Connected components of an edge table, by rounds of neighbour stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import leaves_its_result, save


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the components of the given edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


#: Edges of a task that are contracted together, at most about.
HELD_EDGES = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as forests of up to ``HELD_EDGES``: fewer edges, the same connections."""

    def packed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    a = b = np.zeros(0, np.int64)
    new: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pieces = [(a, b), *new]
        new.clear()
        return forest(*(np.concatenate([p[i] for p in pieces]) for i in (0, 1)))

    for batch in batches:
        new.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held > max(100_000, len(a)):
            (a, b), held = merged(), 0
            if len(a) > HELD_EDGES:
                yield packed(a, b)
                a = b = np.zeros(0, np.int64)
    yield packed(*merged())


#: Edges from which a node counts as one with many: at most one in so many edges is such a node.
MANY = 1000


def _with_least(edges: DataFrame) -> DataFrame:
    """``(a, b, m)``: the edges with the smallest ``b`` of each ``a``.

    Nodes with many edges are few, so theirs is broadcast and their edges stay where they are: no
    node is a hot group.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    many = least.where(F.col("n") > MANY).select(F.col("a").alias("_a"), F.col("m").alias("_m"))
    few = least.where(F.col("n") <= MANY).select("a", "m")
    split = edges.join(F.broadcast(many), F.col("a") == F.col("_a"), "left")
    hot = split.where("_a IS NOT NULL").select("a", "b", F.col("_m").alias("m"))
    return hot.union(split.where("_a IS NULL").select("a", "b").join(few, "a").select("a", "b", "m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` of the distinct edges has one ``b``, and no ``b`` is an ``a``."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


@leaves_its_result
def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes of ``edges (a long, b long)`` but the roots themselves.

    The root is the smallest node of a component.  Rounds of large and small stars (every node
    links its larger neighbours, then its smaller ones, to the smallest) end when the edges are
    stars: each goes from a node to a smaller one, so the centre is then the root.
    Loops are ignored; no edges give no rows.
    """
    contracted = edges.where("a <> b").mapInArrow(_contract, "a long, b long")
    # Forests of tasks with one root meet in tasks as large as Spark makes them, and are contracted again.
    met = contracted.hint("rebalance", F.col("b")).mapInArrow(_contract, "a long, b long")
    now = save(met.distinct(), "edges")
    while True:
        if _are_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.union(now.select("b", "a"))
        # The smallest of a node and its neighbours takes the node and all larger neighbours.
        seen = _with_least(both).select("a", "b", F.least("a", "m").alias("m"))
        larger = F.when(F.col("b") > F.col("a"), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))
        itself = F.when(
            (F.col("b") == F.col("m")) & (F.col("m") < F.col("a")),
            F.struct(F.col("a").alias("x"), F.col("m").alias("y")),
        )
        large = seen.select(F.inline(F.array_compact(F.array(larger, itself)))).where("x <> y").distinct()
        # The smallest smaller neighbour takes the others, and the node itself.
        known = _with_least(large.toDF("a", "b"))
        taken = F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a"))
        now = save(known.select(taken.alias("a"), F.col("m").alias("b")).distinct(), "edges")

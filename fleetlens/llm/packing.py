"""Best-fit packing after a dominance reduction.

Piece lengths are whole numbers up to the capacity, so the whole instance is a histogram of at most
``capacity`` counts, however many pieces there are.  The reduction and the best fit work on those
counts: an entry "m bins that look alike" stands for m sequences with consecutive numbers.  Only
the histogram reaches the driver; pieces get their place by a join on (length, rank within length).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import save
from fleetlens.llm.tokens import WordEncoder

#: Pieces of one (length, bucket) group, about; a hot length is cut into that many more groups.
GROUP_ROWS = 20_000
#: Groups that a hot length is cut into at least.
LEAST_GROUPS = 64


class Layout:
    """Placements ``(length, count, first sequence, offset)`` of a histogram of lengths."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.placed: list[tuple[int, int, int, int]] = []
        self.sequences = 0

    def fix(self, lengths: list[int], count: int) -> int:
        """``count`` new sequences that hold ``lengths``; returns the first one's number."""
        first, offset = self.sequences, 0
        for length in lengths:
            self.placed.append((length, count, first, offset))
            offset += length
        self.sequences += count
        return first


def dominating_set(left: np.ndarray, length: int, capacity: int) -> list[int] | None:
    """Lengths that, put with one piece of ``length``, dominate every other way to fill its bin.

    ``left`` holds the counts of the other pieces.  A set dominates another when the other's
    pieces can be dealt into it, each part into a piece at least as long as the part; an optimal
    packing can then be rearranged to use it.  None when no such set is proven.
    """
    space = capacity - length
    fits = np.flatnonzero(left[: space + 1])
    if not len(fits):
        return []
    largest = int(fits[-1])
    if largest == space:  # one piece fills the bin: all others together fit into its place
        return [largest]
    small = np.repeat(fits[:3], np.minimum(left[fits[:3]], 3))[:3]
    if len(small) < 2 or small[0] + small[1] > space:  # only one more piece fits
        return [largest]
    if len(small) == 3 and small.sum() <= space:
        return None
    # At most two more fit.  For each longer piece x: the longest y <= x that goes with it.
    x = fits
    y = fits[np.searchsorted(fits, np.minimum(x, space - x), side="right") - 1]
    with_same = (y == x) & (left[x] < 2)
    position = np.searchsorted(fits, y) - with_same
    pair = (np.minimum(x, space - x) >= fits[0]) & (position >= 0)
    x, y = x[pair], fits[np.maximum(position[pair], 0)]
    if not len(x) or largest >= (x + y).max():
        return [largest]
    if x[-1] == largest:
        best = int(y[-1])
        if np.all((y <= best) | (x + y <= largest)):
            return [largest, best]
    return None


def reduce_instance(counts: np.ndarray, layout: Layout) -> None:
    """Fix dominating sets, longest piece first, until none is proven; shrinks ``counts``."""
    for length in range(layout.capacity, 0, -1):
        while counts[length]:
            counts[length] -= 1
            found = dominating_set(counts, length, layout.capacity)
            counts[length] += 1
            if found is None:
                break
            need = np.bincount([length, *found], minlength=len(counts))
            used = np.flatnonzero(need)
            # Fewer other pieces never undo the proof, so it holds while the set's pieces last.
            times = int((counts[used] // need[used]).min())
            layout.fix([length, *found], times)
            counts[used] -= need[used] * times


def best_fit(counts: np.ndarray, layout: Layout) -> None:
    """Best fit of the remaining pieces in decreasing length, whole groups of like bins at a time."""
    capacity = layout.capacity
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by space left

    def fill(first: int, bins: int, space: int, length: int, left: int) -> int:
        """Put ``length`` into bins that look alike, as often as it fits; returns what is left."""
        each = space // length
        full = min(bins, left // each)
        parts = [(first, full, each)] if full else []
        left -= full * each
        if full < bins and left:
            parts.append((first + full, 1, left))
            full, left = full + 1, 0
        for start, n, times in parts:
            for i in range(times):
                layout.placed.append((length, n, start, capacity - space + i * length))
            open_bins[space - times * length].append((start, n))
        if full < bins:
            open_bins[space].append((first + full, bins - full))
        return left

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for space in range(length, capacity):
            while left and open_bins[space]:
                first, bins = open_bins[space].pop()
                left = fill(first, bins, space, length, left)
        if left:
            bins = -(-left // (capacity // length))
            first, layout.sequences = layout.sequences, layout.sequences + bins
            fill(first, bins, capacity, length, left)
        counts[length] = 0


def plan_lengths(histogram: dict[int, int], capacity: int) -> Layout:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        counts[length] = count
    layout = Layout(capacity)
    reduce_instance(counts, layout)
    best_fit(counts, layout)
    return layout


def tokenized_pieces(
    docs: DataFrame, tokenizer: str | None, capacity: int, end_id: int, with_ids: bool
) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut only beyond ``capacity``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        size = 4 * capacity
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.encode(text.as_py()) + end
                for n, at in enumerate(range(0, len(raw), size)):
                    part = raw[at : at + size]
                    row = (doc, n, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    if with_ids:
                        out[5].append(np.frombuffer(part, dtype="<i4"))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            types += [pa.list_(pa.int32())] if with_ids else []
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)]
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(cut, schema)


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``_rank``: position from 0 among the pieces of one length, without one task per length."""
    groups = max(LEAST_GROUPS, -(-rows // GROUP_ROWS))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    # Repeated rows share a hash; their number within a partition is no part of any key.
    sizes = salted.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_group").orderBy(*order)
    return (
        salted.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_group"])
        .withColumn("_rank", F.col("_before") + F.col("_inside"))
        .drop("_group", "_before", "_inside")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the method can.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids
    with ``with_ids``.  A null or empty text is one piece that holds the end id alone.  Equal
    lengths are interchangeable; which of them goes where follows from doc_id and content, so
    reruns agree.  Repeated rows are packed each on its own, a null doc_id stays null, an empty
    table gives no rows, and other columns of the input, whatever their names, play no part.
    """
    spark = docs.sparkSession
    pieces = save(tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    layout = plan_lengths(histogram, capacity)
    taken: dict[int, int] = {}
    slots = []
    for length, count, first, offset in layout.placed:
        at = taken.get(length, 0)
        slots.append((length, at, at + count, first - at, offset))
        taken[length] = at + count
    # A few entries for each length at most: bounded by the capacity, not by the input.
    slot_table = spark.createDataFrame(
        slots, "s_length long, s_from long, s_to long, s_shift long, s_offset long"
    )
    place = (
        (F.col("length") == F.col("s_length"))
        & (F.col("_rank") >= F.col("s_from"))
        & (F.col("_rank") < F.col("s_to"))
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return ranked(pieces, sum(histogram.values())).join(F.broadcast(slot_table), place).select(
        *columns,
        (F.col("_rank") + F.col("s_shift")).alias("sequence_id"),
        F.col("s_offset").alias("offset"),
    )

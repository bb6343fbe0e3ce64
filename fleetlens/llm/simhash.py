"""SimHash near-duplicates by balls that meet in the middle.

Two 64-bit fingerprints at 3 or fewer differing bits share a point: their ways of up to 3 steps
meet after one step from one end and two from the other.  Fingerprints of even bit count give all
points one step away; odd ones also those two steps away, for an odd distance always joins an even
and an odd fingerprint, and equal parities are 2 apart at most and meet after one step each.  Of
three differing bits two lie in one half of the word, so two steps within a half are enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import connected_components, forest
from fleetlens.llm.storage import save
from fleetlens.llm.words import split_words, text_slices, xxh64

RADIUS = 3
#: Points that one bucket of the middle holds, about.
BUCKET_POINTS = 2_000_000
LEAST_BUCKETS = 96
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 1.0
_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def steps() -> tuple[np.ndarray, int]:
    """XOR masks: none, the 64 single bits, then pairs of bits within one half; and how many
    masks an even fingerprint takes."""
    pairs = [(a + h, b + h) for h in (0, 32) for a, b in combinations(range(32), 2)]
    two = np.array([(1 << a) | (1 << b) for a, b in pairs], dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), _ONE, two]), 65


def fingerprint_texts(texts: list[bytes], width: int = 3) -> np.ndarray:
    """Majority bits of the hashes of all word shingles of each text; 0 where there is no word."""
    words = split_words(texts)
    count = np.diff(words.first)
    # Shingles of a text start at its words but the last width - 1; a shorter text is one shingle.
    shingles = np.where(count < width, np.minimum(count, 1), count - width + 1)
    edge = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(texts)), shingles)
    begin = np.arange(edge[-1]) - edge[owner] + words.first[owner]
    last = np.minimum(begin + width, words.first[owner + 1]) - 1
    span = words.start[last] + words.length[last] - words.start[begin]
    octets = xxh64(words.data, words.start[begin], span).view(np.uint8).reshape(-1, 8)
    places = octets + np.arange(0, 2048, 256)
    out = np.zeros(len(texts), dtype=np.uint64)
    for i in np.flatnonzero(shingles).tolist():
        of = places[edge[i] : edge[i + 1]].ravel()
        set_ = (np.bincount(of, minlength=2048).reshape(8, 256) @ _BITS).ravel()
        out[i] = _ONE[2 * set_ > shingles[i]].sum()
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the fingerprint of the whole text as a (signed) long, ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_slices(batch.column(1)):
                values = pa.array(fingerprint_texts(texts, width).view(np.int64))
                ids = batch.column(0).slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([ids, values], names=["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _emit(buckets: int):
    """All points of the balls, packed by bucket: points and mask numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, few = steps()
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), 500):
                fps = every[i : i + 500]
                odd = fps[np.bitwise_count(fps) % 2 == 1]
                point = np.concatenate(
                    [(fps[:, None] ^ masks[:few]).ravel(), (odd[:, None] ^ masks[few:]).ravel()]
                )
                mark = np.concatenate(
                    [
                        np.tile(np.arange(few, dtype="<u2"), len(fps)),
                        np.tile(np.arange(few, len(masks), dtype="<u2"), len(odd)),
                    ]
                )
                spread = (point * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                bucket = ((spread * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                point, mark = point[order], mark[order]
                full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([point[cuts[b] : cuts[b + 1]].tobytes() for b in full]),
                        pa.array([mark[cuts[b] : cuts[b + 1]].tobytes() for b in full]),
                    ],
                    names=["bucket", "points", "marks"],
                )

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Links of one bucket as a forest.

    At a point, every member within one step links to every other member (1 + 2 steps, or parity
    makes 2 of it); two members both two steps away do not.  So the links of a point connect what
    the star around its smallest near member connects.
    """
    masks, few = steps()
    point = np.frombuffer(b"".join(table.column("points").to_pylist()), dtype="<u8")
    mark = np.frombuffer(b"".join(table.column("marks").to_pylist()), dtype="<u2")
    order = np.argsort(point, kind="stable")
    point, mark = point[order], mark[order]
    same = point[1:] == point[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    point, mark = point[shared], mark[shared]
    a = b = np.zeros(0, np.int64)
    if len(point):
        fp = point ^ masks[mark]
        first = np.concatenate([[True], point[1:] != point[:-1]])
        begins, size = np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(point)))
        near = mark < few
        centre = np.minimum.reduceat(np.where(near, fp, np.uint64(2**64 - 1)), begins)
        # Without a near member there is no centre, and nobody to link to.
        starred = np.repeat(np.logical_or.reduceat(near, begins), size)
        centre = np.repeat(centre, size)
        linked = starred & (fp != centre) & (np.bitwise_count(fp ^ centre) <= RADIUS)
        a, b = forest(fp[linked].view(np.int64), centre[linked].view(np.int64))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` within the radius."""
    count = fps.count()
    buckets = max(LEAST_BUCKETS, -(-count * 600 // BUCKET_POINTS))
    packed = fps.select("fp").mapInArrow(
        _emit(buckets), "bucket int, points binary, marks binary"
    )
    return packed.groupBy("bucket").applyInArrow(_meet, "a long, b long")


def rooted(prints: DataFrame) -> DataFrame:
    """``_fp, root, first`` of the distinct fingerprints ``fp``: the component's smallest
    fingerprint, and the smallest doc_id of this one."""
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = connected_components(near_links(distinct))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), "first"
    )


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id that links of 3 or fewer differing bits reach.  Null,
    empty and blank texts have fingerprint zero and link like any other; a null doc_id gets the
    component of its text and never names one unless all its documents have none.  Repeated rows
    stay repeated; an empty table gives no rows; other columns play no part.
    """
    prints = save(fingerprints(docs, width), "fingerprints")
    roots = rooted(prints)
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("_fp", "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, null last.

    Of repeated rows the first read stays.  All columns are kept, whatever their names.
    """
    rows = save(
        docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")),
        "rows",
    )
    # The number stands in for the id; the id itself is joined to it, narrow, to choose by.
    numbered = rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    prints = save(fingerprints(numbered, width), "fingerprints").withColumnRenamed("doc_id", "n")
    ids = rows.select(F.col("row"), F.col("doc.doc_id").cast("long").alias("id"))
    known = prints.join(ids, F.col("n") == F.col("row")).select("n", "fp", "id")
    roots = rooted(prints.withColumnRenamed("n", "doc_id"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("n"))
    # First within each fingerprint, so no group of copies meets in one task.
    own = known.groupBy("fp").agg(F.min(order).alias("best"))
    kept = (
        own.join(roots, F.col("fp") == F.col("_fp"))
        .groupBy("root")
        .agg(F.min("best").alias("best"))
        .select(F.col("best.n").alias("kept"))
    )
    return rows.join(kept, F.col("row") == F.col("kept")).select("doc.*")

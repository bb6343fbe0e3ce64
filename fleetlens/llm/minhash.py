"""MinHash near-duplicates: one permutation, optimal densification, banded buckets, stars.

A text is the set of its distinct word shingles, as 64-bit hashes.  One permutation serves all bins
of the signature: the high bits of a hash choose the bin, and a bin holds the smallest hash in it.
An empty bin takes the value of the first full bin on a walk that depends on the bin alone (optimal
densification), so bins of short texts agree as independently as those of long ones.

Texts that share a band of bins meet in a bucket.  A bucket compares its members with a centre only:
as many pairs as members.  Links are confirmed on the full sets.

Texts of buckets whose members still are in several components meet once more, by the exact rule
for sets: two of them that are similar enough share one of their few rarest shingles.  In these small
groups again stars are compared, with further centres among the rest until one component or one
member is left: every pair that meets is compared, or connected already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import connected_components
from fleetlens.llm.storage import leaves_its_result, save
from fleetlens.llm.words import split_words, text_slices, xxh64

#: 64 bands of 8 bins: of pairs with similarity 0.8, fewer than 1 in 100,000 share no band.
BANDS = 64
BAND = 8
BINS = BANDS * BAND
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
#: Full bins are looked for along the walk so often before the rest is found by rank.
WALK = 8
#: By how much the centres that an open bucket tries at once grow from round to round.
CENTRES = 16
#: Counters of shingles, by the first bits of their hashes, that say which are rare: 2 MB.
COUNTER_BITS = 18
#: Bits that say which texts may be wanted again: 1 MB.
FILTER_BITS = 23
#: Pairs of one centre that share a copy of its set, about.
SALT_PAIRS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: walk[t, bin]: the bin looked at in step t; rank[bin, other]: the step that looks at other.
_WALK = np.argsort(_mix(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), axis=0)
_RANK = np.argsort(_WALK, axis=0).T.copy()


def shingle_sets(texts: list[bytes], width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one behind the other, and where each begins."""
    words = split_words(texts)
    count = np.diff(words.first)
    shingles = np.where(count < width, np.minimum(count, 1), count - width + 1)
    edge = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(texts)), shingles)
    begin = np.arange(edge[-1]) - edge[owner] + words.first[owner]
    last = np.minimum(begin + width, words.first[owner + 1]) - 1
    span = words.start[last] + words.length[last] - words.start[begin]
    hashes = xxh64(words.data, words.start[begin], span)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """``values`` (texts x bins) with the empty bins filled; texts without full bins stay as are."""
    out = values.copy()
    doc, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    for step in range(WALK):
        source = _WALK[step, empty]
        met = full[doc, source]
        out[doc[met], empty[met]] = values[doc[met], source[met]]
        doc, empty = doc[~met], empty[~met]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1)).tolist() + [len(doc)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        d, bins = doc[begin], empty[begin:end]
        there = np.flatnonzero(full[d])
        out[d, bins] = values[d, there[_RANK[np.ix_(bins, there)].argmin(axis=1)]]
    return out


def band_keys(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Keys (texts x bands) of sets given by ``shingle_sets``; equal sets have equal keys."""
    many = len(edge) - 1
    owner = np.repeat(np.arange(many), np.diff(edge))
    bins = (hashes >> _SHIFT).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])
    values = np.zeros((many, BINS), np.uint64)
    full = np.zeros((many, BINS), bool)
    values[owner[first], bins[first]] = hashes[first]
    full[owner[first], bins[first]] = True
    dense = densify(values, full).reshape(many, BANDS, BAND)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (many, BANDS))
    for i in range(BAND):
        key = _mix(key ^ dense[:, :, i])
    return key


def _lists(values: np.ndarray, edge: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(edge, pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64))
    )


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")
    )


def sketches(docs: DataFrame, width: int = 2) -> DataFrame:
    """Per row: doc_id, text_hash, set size ``n``, 128-bit digest ``key`` of the set, and its
    ``bands`` (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_slices(batch.column(1)):
                hashes, edge = shingle_sets(texts, width)
                size = np.diff(edge)
                keys = np.concatenate(
                    [
                        band_keys(hashes[edge[i] : edge[min(i + 500, len(texts))]], edge[i : i + 501] - edge[i])
                        for i in range(0, len(texts), 500)
                    ]
                )
                bands = np.concatenate([[0], np.cumsum(np.where(size, BANDS, 0))])
                digest = [
                    hashlib.blake2b(hashes[a:b], digest_size=16).digest()
                    for a, b in zip(edge[:-1], edge[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        batch.column(2).slice(begin, len(texts)),
                        pa.array(size, pa.int64()),
                        pa.array(digest, pa.binary()),
                        _lists(keys[size > 0].ravel(), bands),
                    ],
                    names=["doc_id", "text_hash", "n", "key", "bands"],
                )

    return _narrow(docs).mapInArrow(
        run, "doc_id long, text_hash long, n long, key binary, bands array<long>"
    )


def filter_bits(values: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A bit for each of 2 ** size ranges of hashes: whether one of the ``values (h)`` is in it."""
    piece = 32_768  # bits of one bitmap of Spark's
    bit = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - size))
    found = (
        values.select(bit.alias("bit"))
        .groupBy(F.expr(f"bit div {piece}").alias("part"))
        .agg(F.bitmap_construct_agg(F.col("bit") % piece).alias("bits"))
        .collect()
    )
    whole = np.zeros(((1 << size) // piece, piece // 8), np.uint8)
    for r in found:
        whole[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return whole.ravel()


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes are in a range of the filter."""
    at = hashes.view(np.uint64) >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def maybe_among(bits: np.ndarray):
    """Rows whose hash, in the last column, is in a range of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(bits, batch.column(batch.num_columns - 1).to_numpy())))

    return run


def full_sets(docs: DataFrame, wanted: DataFrame, width: int = 2) -> DataFrame:
    """``(row, members, n)``: the shingle hashes of the texts of ``wanted (row, _id, _hash)``.

    The sets are made again from the texts, for the rows that met only: kept for all rows they would
    be larger than the texts.  Copies of a text differ in doc_id and so are no hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_slices(batch.column(1)):
                hashes, edge = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        _lists(hashes, edge),
                        pa.array(np.diff(edge), pa.int64()),
                    ],
                    names=["row", "members", "n"],
                )

    same = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # Texts that are not wanted are not shuffled, but for a few by chance.
    bits = filter_bits(wanted.select(F.col("_hash").alias("h")))
    narrow = _narrow(docs)
    maybe = narrow.mapInArrow(maybe_among(bits), narrow.schema)
    texts = maybe.join(wanted, same).select("row", "text")
    found = save(texts.mapInArrow(run, "row long, members array<long>, n long"), "full")
    # A document that stands in the table twice, with its doc_id and text, is found twice.
    twice = found.groupBy("row").count().where("count > 1")
    return found if twice.isEmpty() else found.dropDuplicates(["row"])


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars within a batch: (null, row, centre) for members, (bucket, row, null) for centres.

    Only one row of a bucket goes on from each batch, so no bucket is hot in the shuffle.
    """
    for batch in batches:
        rows = np.repeat(batch.column(0).to_numpy(), BANDS)
        buckets = batch.column(1).flatten().to_numpy()
        order = np.lexsort((rows, buckets))
        rows, buckets = rows[order], buckets[order]
        first = np.ones(len(rows), bool)
        first[1:] = buckets[1:] != buckets[:-1]
        centre = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        pairs = np.unique(np.stack([rows[~first], centre[~first]]), axis=1)
        bare = pa.nulls(pairs.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(buckets[first]), bare]),
                pa.array(np.concatenate([rows[first], pairs[0]])),
                pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(pairs[1])]),
            ],
            names=["bucket", "row", "centre"],
        )


def _sorted_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from every row to the first one of its bucket; rows come sorted by (bucket, row)."""
    bucket = centre = None
    for batch in batches:
        buckets, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(rows):
            continue
        first = np.ones(len(rows), bool)
        first[1:] = buckets[1:] != buckets[:-1]
        to = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))].copy()
        if bucket == buckets[0]:
            to[: len(rows) if first.sum() == 1 else np.flatnonzero(first)[1]] = centre
        bucket, centre = buckets[-1], to[-1]
        pairs = np.unique(np.stack([rows, to])[:, rows != to], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def star_pairs(sets: DataFrame) -> DataFrame:
    """Distinct candidate pairs ``(a, b)`` of rows: each bucket's members with its centre."""
    stars = save(
        sets.select("row", "bands").mapInArrow(_local_stars, "bucket long, row long, centre long"),
        "stars",
    )
    local = stars.where("centre is not null").select("row", "centre")
    met = (
        stars.where("centre is null")
        .select("bucket", "row")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "row")
        .mapInArrow(_sorted_stars, "a long, b long")
    )
    return met.union(local).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose full ``sets (row, members, n)`` are similar enough.

    Sizes that differ too much decide without the sets; only sets of the others are shuffled, but for a
    few by chance.  The centre ``b`` of many pairs is dealt over salts, each with its own copy of the
    centre's set.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_PAIRS).alias("salts"))
    sizes = [sets.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b")]
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    able = pairs.join(sizes[0], "a").join(sizes[1].join(many, "b"), "b").where(near)
    salted = save(able.select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt")), "able")
    members = _sets_of(salted, sets)
    left = salted.join(members.select(F.col("row").alias("a"), F.col("members").alias("x")), "a")
    right = (
        salted.select("b", "salt")
        .distinct()
        .join(members.select(F.col("row").alias("b"), F.col("members").alias("y")), "b")
    )
    shared = F.size(F.array_intersect("x", "y"))
    both = left.join(right, ["b", "salt"]).select(
        "a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sizes")
    )
    return both.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")


def _sets_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``row, members`` of the rows of ``pairs (a, b)``; if they are few, hardly any others."""
    members = sets.select("row", "members")
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    rows = wanted.count()
    if 2 * rows >= sets.count():
        return members
    bits = filter_bits(wanted.select(F.xxhash64("row").alias("h")), min(max((16 * rows).bit_length(), 17), 27))
    hashed = members.withColumn("h", F.xxhash64("row"))
    return hashed.mapInArrow(maybe_among(bits), hashed.schema).drop("h")


def _with_component(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members (bucket, row, ...)`` of buckets of more than one component, with ``component``."""
    named = members.join(roots, F.col("row") == F.col("node"), "left").select(
        *members.columns, F.coalesce("root", "row").alias("component")
    )
    ends = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return named.join(ends.where("low < high").select("bucket"), "bucket", "left_semi")


def rare_shingles(sets: DataFrame, percent: int = 80) -> DataFrame:
    """``(bucket, row, n, place, asks)``: every set of ``n`` shingles under its rarest ones.

    Two sets of at least ``percent`` similarity share one of as many rarest shingles as they may
    have apart, and one more; the smaller set needs fewer, those where it ``asks``.  Any order of the
    shingles gives this, if it is the same for all sets; rare ones first makes the groups small.  How
    rare a shingle is, is read from a table of counters of fixed size.
    """
    shift = 64 - COUNTER_BITS
    counted = (
        sets.select(F.explode("members").alias("shingle"))
        .groupBy(F.call_function("shiftrightunsigned", F.col("shingle"), F.lit(shift)).alias("c"))
        .agg(F.count("*").alias("n"))
        .toArrow()
    )
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[counted["c"].to_numpy()] = counted["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            hashes = batch.column(1).flatten().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            rarity = counts[hashes.view(np.uint64) >> np.uint64(shift)]
            order = np.lexsort((hashes, rarity, owner))
            place = np.arange(len(hashes)) - (np.cumsum(size) - size)[owner]
            apart = size - (percent * size + 99) // 100
            asked = size - (2 * percent * size + 99 + percent) // (100 + percent)
            kept = place <= apart[owner]
            columns = [
                hashes[order][kept],
                batch.column(0).to_numpy()[owner[kept]],
                size[owner[kept]],
                place[kept],
                (place <= asked[owner])[kept],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["bucket", "row", "n", "place", "asks"]
            )

    return sets.select("row", "members").mapInArrow(
        run, "bucket long, row long, n int, place long, asks boolean"
    )


def _with_centres(open_: DataFrame, turn: int) -> DataFrame:
    """``open_`` with ``centre``: about ``CENTRES ** (turn + 1)`` of the asking rows of a bucket, and
    at least the first.  The order is the same in all buckets, so that they choose the same rows and
    their pairs coincide."""
    order = F.call_function("shiftrightunsigned", F.xxhash64("row", F.lit(turn)), F.lit(11))
    ordered = open_.withColumn("_order", F.when(F.col("asks"), order / F.lit(2.0**53)))
    sizes = ordered.groupBy("bucket").agg(F.count("_order").alias("_size"), F.min("_order").alias("_first"))
    limit = F.greatest("_first", F.lit(float(CENTRES ** (turn + 1))) / F.col("_size"))
    centre = F.coalesce(F.col("_order") <= limit, F.lit(False))
    return ordered.join(sizes.where("_size > 0"), "bucket").select(*open_.columns, centre.alias("centre"))


def _pairs(marked: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a centre with the members that are not smaller and can be similar.

    If the shared shingle is the first one they share, they have in common what is left behind it at
    most; pairs that share an earlier one meet there.
    """
    centre = marked.where("centre").select(
        "bucket", *[F.col(c).alias(f"_{c}") for c in ("row", "n", "place", "component")]
    )
    needed = F.ceil(percent * (F.col("n") + F.col("_n")) / F.lit(100 + percent))
    left = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place"))
    able = (
        (F.col("component") != F.col("_component"))
        & (F.col("n") >= F.col("_n"))
        & (100 * F.col("_n") >= percent * F.col("n"))
        & (left >= needed)
    )
    return (
        marked.join(centre, "bucket")
        .where(able)
        .select(F.least("row", "_row").alias("a"), F.greatest("row", "_row").alias("b"))
        .distinct()
    )


@leaves_its_result
def linked_sets(
    bands: DataFrame, members_of: Callable[[DataFrame], DataFrame], percent: int = 80
) -> DataFrame:
    """``(node, root)`` of rows of distinct sets, given by ``bands (row, bands)``, that links connect.

    ``members_of`` gives ``(row, members, n)`` for a table of rows.
    """
    tested = save(star_pairs(bands), "pairs")
    met = save(tested.select(F.col("a").alias("row")).union(tested.select("b")).distinct(), "met")
    sets = members_of(met)
    links = save(confirmed(tested, sets, percent), "links")
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = save(connected_components(links), "roots")
    banded = bands.join(met, "row", "left_semi").select("row", F.explode("bands").alias("bucket"))
    apart = save(_with_component(banded, roots).select("row").distinct(), "apart")
    members = rare_shingles(sets.join(apart, "row", "left_semi"), percent)
    turn = 0
    while True:
        marked = save(_with_centres(_with_component(members, roots), turn), "marked")
        if marked.isEmpty():
            return roots
        pairs = save(_pairs(marked, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tested = tested.union(pairs)
            found = save(confirmed(pairs, sets, percent), "links")
            if not found.isEmpty():
                links = links.union(found)
                roots = save(connected_components(links), "roots")
        members = marked.withColumn("asks", F.col("asks") & ~F.col("centre")).drop("component", "centre")
        turn += 1


def minhash_components(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id and whether it is kept.

    component_id is the smallest doc_id that links of ``percent`` or more similarity reach.  Null
    and blank texts have no shingles and link with nothing, not with each other: their component is
    their own doc_id.  A null doc_id gets the component of its text, never names one, and is kept
    only if no document of the component has a doc_id.  Repeated rows stay repeated.  An empty table
    gives no rows; other columns play no part.
    """
    rows = sketches(docs, width).withColumn("row", F.monotonically_increasing_id())
    sets = save(rows, "sketches")
    # A copy that can be found again by its doc_id and text stands for all with its set.
    copy = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = save(
        sets.where("n > 0")
        .groupBy("key")
        .agg(
            F.min("row").alias("row"),
            F.min("doc_id").alias("least"),
            F.min(copy).alias("copy"),
            F.first("bands").alias("bands"),
        ),
        "distinct",
    )
    found_by = distinct.select(
        "row", F.col("copy.doc_id").alias("_id"), F.col("copy.text_hash").alias("_hash")
    )
    roots = linked_sets(
        distinct.select("row", "bands"),
        lambda met: full_sets(docs, save(found_by.join(met, "row"), "wanted"), width),
        percent,
    )
    placed = distinct.join(roots, F.col("row") == F.col("node"), "left").select(
        F.col("key").alias("_key"), F.coalesce("root", "row").alias("component"), "least"
    )
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("_key", "component_id")
    found = sets.select("doc_id", "n", "key").join(named, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )

"""Fuzzy line deduplication by MinHash.

Equal lines are found by a 128-bit key.  Distinct lines get a one-permutation MinHash signature of
their character shingles; bands of it put likely neighbours into groups.  A group first gives the
pairs of its members with one centre, or with the centres of the slices of text they came in; pairs are compared by exact Jaccard similarity, those of two
long lines only if their signatures agree at all well; of small groups whose
members are not all connected all pairs that are apart follow; large ones try further centres, and their
lines still apart are joined by the rarest of
their shingles, which any similar pair shares, so no candidate is left out.  Verified
pairs make components, and of each component the first line of the first document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import connected_components
from fleetlens.llm.minhash import among, filter_bits
from fleetlens.llm.storage import leaves_its_result, save

#: Characters of a shingle: long enough that long unrelated lines share few.
SHINGLE = 9
SIMILARITY = 0.8
#: Bands of rows: a pair at the least similarity is missed with chance (1 - 0.8^5)^20 = 0.0004.
BANDS, ROWS = 20, 5
#: Share of the signature that a pair must have in common to be compared in full: 0.3 below the
#: least similarity, some seven standard deviations.
SKETCH = 0.5
#: Distinct shingles from which a signature is taken to tell that; most of its bins are then full.
SKETCHED = 200
BUCKET_ENTRIES = 1_000_000
#: Bytes of lines whose shingles are in memory at once, about; one longer line stands alone.
PORTION = 300_000
#: Characters whose shingles are hashed at once: what a processor's cache holds.
HASHED = 100_000
LEAST_BUCKETS = 96
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Lenders that an empty bin asks one by one before the rest is found by rank.
WALK = 24
#: Counters of shingles, by the first bits of their hashes, that say which are rare, and parts they are added in.
COUNTER_BITS, COUNTER_PARTS = 18, 64
#: Members of a group up to which all pairs that are apart are compared: as many as the members at most
#: half so often.
WHOLE = 64
#: Rounds of new centres for larger groups that are not connected yet.
CENTRES = 2
_ENTRY = np.dtype([("key", "<u8"), ("line", "<i8")])
#: White space other than single blanks inside a line.
_UNEVEN = ["  ", " \n", "\n "] + [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]
_STAR = np.dtype([("grp", "<i8"), ("a", "<i8"), ("b", "<i8")])


def normal_line(line: str) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join(line.lower().split())


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def shingle_hashes(lines: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of every line, and which line it is of; a shorter line is one shingle."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    points = np.concatenate([points, np.zeros(width, np.uint64)])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = np.maximum(size - width + 1, np.minimum(size, 1))
    owner = np.repeat(np.arange(len(lines)), count)
    edge = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.repeat(begin - edge, count) + np.arange(len(owner))
    # Hashes of runs of doubled length, put together to runs of ``width``.
    rolled, done, run, reach, factor = None, 0, points, 1, 0x100000001B3
    while True:
        if width & reach:
            ahead = run[done : done + len(points) - width]
            rolled = ahead if rolled is None else rolled * np.uint64(factor) + ahead
            done += reach
        if 2 * reach > width:
            break
        run = run[:-reach] * np.uint64(factor) + run[reach:]
        factor, reach = factor * factor % 2**64, 2 * reach
    value = _mix(rolled[at])
    for i in np.flatnonzero((size > 0) & (size < width)).tolist():
        own = 1469598103934665603
        for p in points[begin[i] : begin[i] + size[i]].tolist():
            own = (own * 0x100000001B3 + p) % 2**64
        value[edge[i]] = _mix(np.array([own], dtype=np.uint64))[0]
    return value, owner


def _distinct(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct shingles, sorted within the line."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def shingle_counts(lines: list[str]) -> np.ndarray:
    """Distinct shingles of every line."""
    return np.bincount(_distinct(*shingle_hashes(lines))[1], minlength=len(lines))


def signatures(lines: list[str], bins: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation MinHash (lines x bins); every line has a shingle."""
    return _signatures(*shingle_hashes(lines), len(lines), bins)


def _signatures(value: np.ndarray, owner: np.ndarray, many: int, bins: int = BANDS * ROWS) -> np.ndarray:
    place = ((value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    empty = np.uint64(2**64 - 1)
    least = np.full(many * bins, empty)
    np.minimum.at(least, owner * bins + place, _mix(value + _ODD) >> np.uint64(1))
    sign = least.reshape(many, bins)
    # An empty bin borrows from the first full one in an order of its own, so bins that borrow are
    # as independent as full ones and a band of a short line is as selective as one of a long line.
    rank, order = _lenders(bins)
    full = sign != empty
    line, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    for step in range(1, min(WALK, bins)):
        lender = order[bin_, step]
        met = full[line, lender]
        sign[line[met], bin_[met]] = sign[line[met], lender[met]]
        line, bin_ = line[~met], bin_[~met]
    # Lines of very few shingles are left.
    rest = np.unique(line)
    for begin in range(0, len(rest), 500):
        some = rest[begin : begin + 500]
        row, lender = np.nonzero(full[some])
        first = np.searchsorted(row, np.arange(len(some)))
        best = np.minimum.reduceat(rank[lender], first, axis=0)
        sign[some] = np.take_along_axis(sign[some], order[np.arange(bins), best], axis=1)
    return _mix(sign)


@lru_cache(maxsize=4)
def _lenders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every lender (row) for every bin (column), and the lender of every bin and rank.

    A bin is the first lender of its own.
    """
    order = np.random.default_rng(29).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)
    order = np.array([np.concatenate([[i], o[o != i]]) for i, o in enumerate(order)])
    rank = np.argsort(order, axis=1).T
    return np.ascontiguousarray(rank.astype(np.uint8 if bins <= 256 else np.int32)), order


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of the bands (lines x bands)."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // HASHED, prepend=-1)).tolist() + [len(lines)]
    parts = [signatures(lines[i:j], bands * rows) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    sign = np.concatenate(parts or [np.zeros((0, bands * rows), np.uint64)]).reshape(len(lines), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(lines), bands)).copy()
    for i in range(rows):
        keys = _mix(keys * _ODD + sign[:, :, i])
    return keys


def jaccard(a: str, b: str, width: int = SHINGLE) -> float:
    """Exact similarity of the shingle sets of two normal lines."""
    x, y = (
        {s[i : i + width] for i in range(max(1, len(s) - width + 1))} if s else set() for s in (a, b)
    )
    return len(x & y) / len(x | y) if x or y else 1.0


def normal_lines(text: str) -> list[str]:
    """``normal_line`` of what "\\n" separates; most texts are in that form but for the case."""
    text = text.lower()
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in _UNEVEN):
        return [" ".join(line.split()) for line in text.split("\n")]
    return text.split("\n")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Of batches of ``_row, doc_id, text``: number of the text in its batch, place and normal line of the
    lines that have a word, with the batch and the two halves of the lines' keys."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        owner, places, lines, held = [], [], [], 0
        for i, text in enumerate(batch.column(2)):
            own = normal_lines(text.as_py() or "")
            full = [k for k, line in enumerate(own) if line]
            owner += [i] * len(full)
            places += full
            lines += own if len(full) == len(own) else [own[k] for k in full]
            held += len(text.as_py() or "")
            if held > 1_000_000 or i + 1 == batch.num_rows:
                raw = b"".join([digest(line.encode("utf-8", "surrogatepass")) for line in lines])
                key = (np.frombuffer(raw, ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                yield batch, np.array(owner, np.int64), np.array(places, np.int32), key[1::2], key[::2], lines
                owner, places, lines, held = [], [], [], 0


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, row, pos, line, line2`` of the lines."""
    for batch, owner, pos, line, line2, _ in _read(batches):
        at = pa.array(owner)
        columns = [batch.column(1).take(at), batch.column(0).take(at), pa.array(pos), pa.array(line), pa.array(line2)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "pos", "line", "line2"])


def _of_rows(rows: DataFrame) -> DataFrame:
    return rows.select("_row", F.col("doc_id").cast("long"), F.col("text").cast("string"))


def line_table(rows: DataFrame) -> DataFrame:
    """``doc, row, pos, line, line2`` of every line that has a word.

    From ``_row``, ``doc_id`` and ``text``.  (line, line2) is the 128-bit key of the normal line.
    """
    schema = "doc long, row long, pos int, line long, line2 long"
    return _of_rows(rows).mapInArrow(_line_keys, schema)


def _texts_of(bits: np.ndarray):
    """Lines and texts of rows whose line may be wanted; a line seen before in the task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for *_, line, _, texts in _read(batches):
            at = np.flatnonzero(among(bits, line))
            new = [i for i, x in zip(at.tolist(), line[at].tolist(), strict=True) if x not in seen and not seen.add(x)]
            columns = [pa.array(line[new]), pa.array([texts[i] for i in new], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "text"])
            if len(seen) > 300_000:
                seen.clear()

    return run


def _entries(buckets: int):
    """Band entries of the lines, packed by bucket; a line seen before in the task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ids, texts, held = [], [], 0
        # Reading and packing share one worker.
        for *_, line, _, lines in _read(batches):
            for x, text in zip(line.tolist(), lines, strict=True):
                if x not in seen:
                    seen.add(x)
                    ids.append(x)
                    texts.append(text)
                    held += len(text)
                    if held > 400_000 or len(ids) == 4000:
                        yield _pack(ids, texts, buckets)
                        ids, texts, held = [], [], 0
            if len(seen) > 300_000:
                seen.clear()
        if ids:
            yield _pack(ids, texts, buckets)

    return run


def _pack(ids: list[int], texts: list[str], buckets: int) -> pa.RecordBatch:
    """Entries by bucket.

    Lines of these texts with one key are a star already, in a bucket behind the others, and only
    its centre is an entry: a key that many lines have costs its bucket one entry per slice.
    """
    keys = band_keys(texts)
    entries = np.empty(keys.size, dtype=_ENTRY)
    entries["key"] = keys.ravel()
    entries["line"] = np.repeat(np.array(ids, dtype=np.int64), keys.shape[1])
    entries, stars = _starred(entries)
    bucket = ((entries["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    entries = entries[order]
    full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    packed = [entries[cuts[b] : cuts[b + 1]].tobytes() for b in full]
    if len(stars):
        full.append(buckets + ids[0] % buckets)
        packed.append(stars.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "entries"]
    )


def _starred(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry per key, the centre's, and the other members of its group with it.

    The centre is the member of the smallest hash of line and group, so a line's groups have
    different ones.
    """
    if not len(entries):
        return entries, np.zeros(0, _STAR)
    entries = entries[np.argsort(entries["key"])]
    same = entries["key"][1:] == entries["key"][:-1]
    # Most keys stand alone; the others are sorted by the hash as well.
    shared = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    some = entries[shared]
    entries[shared] = some[np.lexsort((_mix(some["line"].view("<u8") ^ some["key"]), some["key"]))]
    again = (entries["key"][1:] == entries["key"][:-1]) & (entries["line"][1:] == entries["line"][:-1])
    entries = entries[np.concatenate([[True], ~again])]
    first = np.concatenate([[True], entries["key"][1:] != entries["key"][:-1]])
    start = np.flatnonzero(first)
    lead = np.repeat(start, np.diff(np.append(start, len(entries))))
    stars = np.empty((~first).sum(), dtype=_STAR)
    stars["grp"] = entries["key"][~first].view("<i8")
    stars["a"], stars["b"] = entries["line"][lead[~first]], entries["line"][~first]
    return entries[start], stars


def _stars(buckets: int):
    """Every member of a group of two or more with a centre of the group."""

    def run(table: pa.Table) -> pa.Table:
        raw = b"".join(table.column("entries").to_pylist())
        if table.column("bucket")[0].as_py() < buckets:
            stars = _starred(np.frombuffer(raw, dtype=_ENTRY))[1]
        else:
            stars = np.frombuffer(raw, dtype=_STAR)
        return pa.table({c: stars[c].copy() for c in ("grp", "a", "b")})

    return run


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``PORTION`` bytes of text: what is hashed at once."""
    texts = batch.column(column)
    size = np.fromiter(map(len, texts.cast(pa.binary()).to_pylist()), np.int64, len(texts))
    at = np.cumsum(size) // PORTION + np.arange(len(texts)) // 500
    cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [len(texts)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(begin, end - begin)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with a byte of every signature bin and four of the number of distinct shingles."""
    for batch in batches:
        for part in _portions(batch, 1):
            value, owner = shingle_hashes(part.column(1).to_pylist())
            sign = _signatures(value, owner, len(part)).astype(np.uint8)
            # Slices have fewer than 1024 lines; 54 bits tell the shingles of a line apart.
            key = np.sort((owner.astype(np.uint64) << np.uint64(54)) | (value >> np.uint64(10)))
            new = np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]])
            size = np.bincount((key[new] >> np.uint64(54)).astype(np.int64), minlength=len(part)).astype("<u4")
            sketch = [s.tobytes() + n.tobytes() for s, n in zip(sign, size, strict=True)]
            yield part.append_column("sketch", pa.array(sketch, pa.binary()))


def likely_pairs(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sketches (rows of bytes) can be similar enough.

    Sizes bound the similarity exactly.  Signatures are asked only if both lines have shingles
    enough for them to tell; a pair with a shorter line is always compared in full.
    """
    m, n = (np.ascontiguousarray(a[:, -4:]).view("<u4").ravel().astype(np.int64) for a in (x, y))
    least, most = np.minimum(m, n), np.maximum(m, n)
    agree = (x[:, :-4] == y[:, :-4]).mean(axis=1) >= SKETCH
    return (least >= similarity * most - 1e-6) & (agree | (least < SKETCHED))


def _likely(similarity: float):
    """Pairs that likely_pairs lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in (2, 3)
                )
                good = likely_pairs(x, y, similarity)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _both(pairs: DataFrame, lines: DataFrame, column: str) -> DataFrame:
    """``a, b`` and ``column`` of either line."""
    left, right = (lines.select(F.col("line").alias(c), F.col(column).alias(f"{column}_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", f"{column}_a", f"{column}_b")


def similar(x: list[str], y: list[str], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether ``jaccard`` of the lines ``x[i], y[i]`` is at least ``similarity``, for up to 1024 pairs.

    Shingles are counted by 54 bits of their hash.  Where a chance equality could change the answer,
    and for lines without a whole shingle, the texts decide.
    """
    keys, sizes = [], []
    for side in (x, y):
        value, owner = shingle_hashes(side)
        key = np.sort((owner.astype(np.uint64) << np.uint64(54)) | (value >> np.uint64(10)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        keys.append(key)
        sizes.append(np.bincount((key >> np.uint64(54)).astype(np.int64), minlength=len(side)))
    both = np.sort(np.concatenate(keys))
    again = both[1:][both[1:] == both[:-1]]
    shared = np.bincount((again >> np.uint64(54)).astype(np.int64), minlength=len(x))
    either = sizes[0] + sizes[1] - shared
    good = shared >= similarity * either
    short = np.fromiter((min(len(a), len(b)) < SHINGLE for a, b in zip(x, y, strict=True)), bool, len(x))
    for i in np.flatnonzero(short | (np.abs(shared - similarity * either) < 2)).tolist():
        good[i] = jaccard(x[i], y[i]) >= similarity
    return good


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough: by their sketches, then in full."""
    likely = _both(pairs, lines, "sketch").mapInArrow(_likely(similarity), "a long, b long")
    return _in_full(likely, lines, similarity)


def _in_full(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 2):
                good = similar(part.column(2).to_pylist(), part.column(3).to_pylist(), similarity)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _both(pairs, lines, "text").mapInArrow(run, "a long, b long")


@leaves_its_result
def line_components(rows: DataFrame, count: int, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, root)`` of the lines that are linked to others; see connected_components.

    ``rows`` (as for line_table) have ``count`` lines; ids are the lower halves of the keys.
    """
    entries = count * BANDS
    buckets = max(LEAST_BUCKETS, -(-entries // BUCKET_ENTRIES))
    packed = _of_rows(rows).mapInArrow(_entries(buckets), "bucket int, entries binary")
    stars = save(
        packed.groupBy("bucket").applyInArrow(
            _stars(buckets), "grp long, a long, b long"
        ),
        "stars",
    )
    involved = save(
        stars.select("a").union(stars.select("b")).distinct().withColumnRenamed("a", "_l"), "involved"
    )
    # Only the texts of lines that met are handed on, but for a few by chance.
    size = min(max((16 * involved.count()).bit_length(), 17), 27)
    bits = filter_bits(involved.select(F.col("_l").alias("h")), size)
    chosen = _of_rows(rows).mapInArrow(_texts_of(bits), "line long, text string")
    chosen = chosen.join(involved, F.col("line") == F.col("_l"), "left_semi")
    texts = chosen.groupBy("line").agg(F.first("text").alias("text"))
    texts = save(texts.mapInArrow(_sketched, "line long, text string, sketch binary"), "texts")
    pairs = stars.select("a", "b").distinct()
    links = save(_verified(pairs, texts, similarity), "links")
    found = connected_components(links)
    members = stars.select("grp", F.col("a").alias("m")).union(stars.select("grp", "b")).distinct()
    left = _apart(members, found)
    if left.isEmpty():
        return found
    pairs = _pairs_in_groups(left.where(F.col("n") <= WHOLE), texts, similarity)
    more = save(_in_full(pairs, texts, similarity), "links")
    if not more.isEmpty():
        found = _merged(found, more)
    members = left.where(F.col("n") > WHOLE).select("grp", "m")
    for turn in range(0 if members.isEmpty() else CENTRES + 1):
        left = _apart(members, found)
        if left.isEmpty():
            break
        if turn < CENTRES:
            pairs = _with_new_centres(left, turn)
        else:
            pairs = _sharing_rare_shingles(left, texts, similarity)
        more = save(_verified(pairs, texts, similarity), "links")
        if not more.isEmpty():
            found = _merged(found, more)
        members = left.select("grp", "m")
    return found


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``found`` with further links: only these go through the rounds, between roots."""
    roots = [found.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"_root_{c}")) for c in "ab"]
    joined = more.join(roots[0], F.col("a") == F.col("_a"), "left").join(roots[1], F.col("b") == F.col("_b"), "left")
    between = joined.select(F.coalesce("_root_a", "a").alias("a"), F.coalesce("_root_b", "b").alias("b"))
    moved = connected_components(between)
    new = moved.toDF("_old", "_new")
    named = found.join(new, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
    return save(named.union(moved), "found")


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """``grp, m, root, n`` of the groups of ``n`` lines, three or more, that are not connected yet."""
    rooted = members.join(found, F.col("m") == F.col("node"), "left").select(
        "grp", "m", F.coalesce("root", "m").alias("root")
    )
    split = rooted.groupBy("grp").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_n")
    ).where("_n > 2 AND _low < _high").select(F.col("grp").alias("_g"), F.col("_n").alias("n"))
    return save(rooted.join(split, F.col("grp") == F.col("_g")).drop("_g"), "apart")


def _pairs_in_groups(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All pairs of a group's members that are apart and whose sketches can be similar enough.

    Groups have ``WHOLE`` members at most.
    """

    def pairs(grp: np.ndarray, line: np.ndarray, root: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        out = [np.zeros((0, 2), np.int64)]
        for ahead in range(1, WHOLE):
            near = grp[ahead:] == grp[:-ahead]
            if not near.any():
                break
            at = np.flatnonzero(near & (root[ahead:] != root[:-ahead]))
            for some in np.split(at, range(20_000, len(at), 20_000)):
                some = some[likely_pairs(sketch[some], sketch[some + ahead], similarity)]
                out.append(np.sort(np.stack([line[some], line[some + ahead]], axis=1), axis=1))
        a, b = np.unique(np.concatenate(out), axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                new = [c.to_numpy() for c in batch.columns[:3]]
                new.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
                held = [np.concatenate(c) for c in zip(held, new, strict=True)] if held else new
                # The last group may go on in the next batch.
                end = int(np.argmax(held[0] == held[0][-1]))
                yield pairs(*[c[:end] for c in held])
                held = [c[end:] for c in held]
        if held:
            yield pairs(*held)

    sketches = texts.select("line", "sketch")
    rows = left.join(sketches, F.col("m") == F.col("line")).select("grp", "m", "root", "sketch")
    ordered = rows.repartition("grp").sortWithinPartitions("grp")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _with_new_centres(left: DataFrame, turn: int) -> DataFrame:
    """Pairs of a group's members with one more of them, if they are apart."""
    pick = F.struct(F.xxhash64("m", "grp", F.lit(turn)).alias("h"), "m", "root")
    centre = left.groupBy("grp").agg(F.min(pick).alias("c"))
    centre = centre.select(F.col("grp").alias("_g"), F.col("c.m").alias("a"), F.col("c.root").alias("_r"))
    joined = left.join(centre, (F.col("grp") == F.col("_g")) & (F.col("root") != F.col("_r")))
    return joined.select("a", F.col("m").alias("b")).distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many lines of the task have a shingle of each counter, in parts."""
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for batch in batches:
        for part in _portions(batch, 2):
            value = _distinct(*shingle_hashes(part.column(2).to_pylist()))[0]
            total += np.bincount(
                (value >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total)
            )
    if total.any():
        counts = [c.astype("<u4").tobytes() for c in np.split(total, COUNTER_PARTS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(counts, pa.binary())],
            names=["part", "counts"],
        )


def _added(table: pa.Table) -> pa.Table:
    """The sum of one part's counters."""
    total = sum(np.frombuffer(c, "<u4").astype("<i8") for c in table["counts"].to_pylist())
    return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _rarest(counts: np.ndarray, similarity: float):
    """``line, root, n, at, s``: of the ``n`` distinct shingles of a line, in order of rarity, the first
    ones ``s`` and their places ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 2):
                value, owner = _distinct(*shingle_hashes(part.column(2).to_pylist()))
                rarity = counts[(value >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                order = np.lexsort((value, rarity, owner))
                value, owner = value[order].view(np.int64), owner[order]
                n = np.bincount(owner, minlength=len(part))
                at = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
                first = at <= (n - np.ceil(n * similarity - 1e-6))[owner]
                of = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(of),
                        part.column(1).take(of),
                        pa.array(n[owner[first]], pa.int32()),
                        pa.array(at[first], pa.int32()),
                        pa.array(value[first]),
                    ],
                    names=["line", "root", "n", "at", "s"],
                )

    return run


def _sharing_rare_shingles(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines that are apart and share one of their rarest shingles.

    Of lines of n shingles, similar ones share at least ``similarity`` * n, so with all shingles in
    one order they share one of the first n - similarity * n + 1.  The rarest come first: what
    many lines have, such as a template, makes no pairs.  How rare a shingle is, is read from a table
    of counters of fixed size; any order is exact if it is the same for all lines.  The first shingle
    that two lines share leaves room for no more than the rest of the shorter remainder, so most are
    told apart by their places; that bound is exact as well.
    """
    lines = left.select(F.col("m").alias("_m"), "root").distinct()
    lines = texts.join(lines, F.col("line") == F.col("_m")).select("line", "root", "text")
    counted = lines.mapInArrow(_counted, "part int, counts binary")
    counts = np.zeros((COUNTER_PARTS, (1 << COUNTER_BITS) // COUNTER_PARTS), np.int64)
    for row in counted.groupBy("part").applyInArrow(_added, "part int, counts binary").collect():
        counts[row["part"]] = np.frombuffer(bytes(row["counts"]), "<i8")
    schema = "line long, root long, n int, at int, s long"
    keys = lines.mapInArrow(_rarest(counts.ravel(), similarity), schema)
    keys = save(keys, "rare")
    other = keys.toDF("_line", "_root", "_n", "_at", "_s")
    least = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("_n")) - F.lit(1e-6)
    near = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) >= least
    joined = keys.join(other, (F.col("s") == F.col("_s")) & (F.col("root") < F.col("_root")) & near)
    return joined.select(F.col("line").alias("a"), F.col("_line").alias("b")).distinct()


def kept_lines(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of ``_row, doc_id, text``: per _row (as ``_line_row``) its doc_id (as ``_line_doc``), its number
    of ``lines`` and the positions ``kept``.

    Of each component the first line stays, in order of doc_id, _row and position.
    """
    narrow = save(line_table(rows), "lines")
    found = line_components(rows, narrow.count(), similarity)
    nodes = found.union(found.select("root", "root").distinct())
    firsts = narrow.groupBy("line", "line2").agg(F.min(F.struct("doc", "row", "pos")).alias("first"))
    # Lines without a link stand for themselves, by both halves of their key.
    best = (
        firsts.join(nodes, F.col("line") == F.col("node"), "left")
        .groupBy(
            F.coalesce("root", "line").alias("_root"),
            F.when(F.col("root").isNull(), F.col("line2")).alias("_own"),
        )
        .agg(F.min("first").alias("f"))
    )
    kept = best.groupBy("f.row").agg(F.array_sort(F.collect_list("f.pos")).alias("kept"))
    counts = narrow.groupBy("doc", "row").agg(F.count("*").alias("lines"))
    return counts.join(kept.withColumnRenamed("row", "_k"), F.col("row") == F.col("_k"), "left").select(
        F.col("row").alias("_line_row"), F.col("doc").alias("_line_doc"), "lines", F.coalesce("kept", F.array().cast("array<int>")).alias("kept")
    )


def line_counts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row per document with a line: doc_id, lines, kept_lines and ``kept``, their positions.

    Lines are what "\\n" separates; blank ones are neither counted nor removed.  Lines are
    compared in lower case with single blanks.  A null, empty or blank text gives no row, nor does
    an empty table; a null doc_id comes before all others; of repeated rows the first read keeps
    its lines.  Other columns play no part.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Row numbers are used within the one scan that is saved.
    return kept_lines(rows, similarity).select(
        F.col("_line_doc").alias("doc_id"), "lines", F.size("kept").cast("long").alias("kept_lines"), "kept"
    )


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all rows and other columns stay.

    ``n_chars``, if there is one, is set to the length of the new text.  Texts without a line and
    blank lines stay as they are.
    """
    numbered = save(
        docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_row")),
        "numbered",
    )
    found = kept_lines(numbered.select("_row", "doc.doc_id", "doc.text"), similarity)
    stays = F.expr(
        "array_join(filter(split(doc.text, '\\n', -1), "
        "(l, i) -> array_contains(kept, i) OR NOT l RLIKE '\\\\S'), '\n')"
    )
    text = F.when(F.col("kept").isNull(), F.col("doc.text")).otherwise(stays)
    joined = numbered.join(found, F.col("_row") == F.col("_line_row"), "left")
    joined = joined.select("doc", text.alias("new"))
    columns = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[c.alias(name) for name, c in columns.items()])

"""Ranked lexical search, term at a time with a limit on accumulators.

The index is a table of shards: a few megabytes of texts each, with their lengths and the postings
of their terms.  Corpus statistics come from the shards by sums.  A task goes through its shards; in
each, an item takes its terms rarest first and adds their weights to the accumulators of the
documents.  As soon as all terms left together cannot lift a new document to the k-th best partial
score known, no accumulator is created any more; those there are continue to be updated exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.storage import LARGE_ROWS, save, small_batches
from fleetlens.llm.words import split_words, text_slices, xxh64

#: Bytes of text in a shard, about; one longer text is a shard of its own.
SHARD_BYTES = 2_000_000
#: Query terms that one pass over the index takes along, about (24 bytes each).
BLOCK_TERMS = 200_000
#: Partial rankings of an item meet in so many groups before the last one.
MERGE_GROUPS = 64
#: Terms: ASCII letters and digits and everything beyond ASCII.
_TERM = [48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)]
_TO_BLANKS = bytes(b if _TERM[b] else 32 for b in range(256))


def count_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, A-Z lower-cased: text, hash and count of each, and terms of each text.

    Terms are known by their XXH64.
    """
    words = split_words([t.translate(_TO_BLANKS) for t in texts])
    many = np.diff(words.first)
    owner = np.repeat(np.arange(len(texts)), many)
    hashes = xxh64(words.data, words.start, words.length).view(np.int64)
    order = np.lexsort((owner, hashes))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(owner)))
    return owner[new], hashes[new], counts, many


_SHARD = (
    "docs array<long>, lengths array<long>, documents long, total long, "
    "terms array<long>, starts array<int>, places array<int>, counts array<int>"
)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in text_slices(batch.column(1), SHARD_BYTES):
            place, hashes, counts, many = count_terms(texts)
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            ids = batch.column(0).slice(begin, len(texts))
            columns = [
                ids,
                pa.array(many, pa.int64()),
                pa.array(hashes[new]),
                pa.array(np.append(np.flatnonzero(new), len(hashes)), pa.int32()),
                pa.array(place, pa.int32()),
                pa.array(counts, pa.int32()),
            ]
            lists = [
                pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.concat_arrays([c]))
                for c in columns
            ]
            totals = [pa.array([int((many > 0).sum())]), pa.array([int(many.sum())])]
            yield pa.RecordBatch.from_arrays(
                lists[:2] + totals + lists[2:], names=[c.split()[0] for c in _SHARD.split(", ")]
            )


def index_shards(docs: DataFrame) -> DataFrame:
    """The index of all texts: per shard, its documents, their lengths in terms, and postings.

    ``terms`` are sorted; those of term i are ``places`` (positions in ``docs``) and ``counts`` from
    ``starts[i]`` to ``starts[i + 1]``.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(_index, _SHARD)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in text_slices(batch.column(1)):
            place, hashes, _, _ = count_terms(texts)
            ids = batch.column(0).slice(begin, len(texts)).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes)], names=["item_id", "term"])


def weighted_items(items: DataFrame, shards: DataFrame) -> DataFrame:
    """``(item_id, term, w, df)`` of the items' distinct terms that some document holds."""
    narrow = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    asked = save(narrow.mapInArrow(_item_terms, "item_id long, term long").distinct(), "asked")
    starts = F.col("starts")
    held = shards.select(
        F.explode(F.arrays_zip(F.col("terms").alias("term"), starts, F.slice(starts, 2, F.size(starts)).alias("stops"))).alias("t")
    ).where("t.term is not null")
    found = (
        held.select(F.col("t.term").alias("term"), (F.col("t.stops") - F.col("t.starts")).alias("n"))
        .join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("n").alias("df"))
    )
    size = shards.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("N")).first()["N"]
    odds = F.lit(2 * size + 2).cast("double") / (2 * F.col("df") + 1)
    return asked.join(found, "term").select(
        "item_id", "term", F.floor(1000 * F.log(odds)).cast("long").alias("w"), "df"
    )


class _Ranking:
    """The best k documents of every item so far: scores, then doc_ids with null last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def threshold(self, item: int) -> int:
        """The k-th best score; 0 while there are fewer documents."""
        best = self.best[item]
        return -best[-1][0] if len(best) == self.k else 0

    def add(self, item: int, scores: np.ndarray, docs: list[int | None]) -> None:
        found = [(-s, d is None, d or 0) for s, d in zip(scores.tolist(), docs, strict=True)]
        self.best[item] = sorted(self.best[item] + found)[: self.k]


def _kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def rank_item(
    terms: np.ndarray,
    weights: np.ndarray,
    impacts: list[np.ndarray],
    places: list[np.ndarray],
    size: int,
    k: int,
    floor: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and exact scores of all documents that can be among the best k of one item.

    ``impacts[t]`` and ``places[t]`` are the postings of term t, rarest term first; ``floor`` is a
    k-th best score known from elsewhere.  Also returns how many accumulators there were.
    """
    score = np.zeros(size, np.int64)
    held = np.zeros(size, bool)
    bounds = np.array([w * int(i.max()) for w, i in zip(weights.tolist(), impacts, strict=True)], np.int64)
    left = np.cumsum(bounds[::-1])[::-1]  # of this term and all behind it
    creating, best = True, floor
    for t in range(len(terms)):
        if creating and t:
            best = max(floor, _kth(score[held], k))
        # A document without accumulator gets left[t] at most; an equal score may still win by doc_id.
        creating = creating and int(left[t]) >= best
        at, gain = places[t], impacts[t] * weights[t]
        if creating:
            held[at] = True
            score[at] += gain
        else:
            on = held[at]
            score[at[on]] += gain[on]
    there = np.flatnonzero(held & (score > 0))
    values = score[there]
    cut = max(floor, _kth(values, k))
    return there[values >= cut], values[values >= cut], int(held.sum())


def _search(block: list[tuple], documents: int, total: int, k: int):
    """Ranks the shards of a task for the items of a block of ``(item_id, term, w, df)``."""
    ids = sorted({row[0] for row in block}, key=lambda i: (i is None, i))
    number = {i: n for n, i in enumerate(ids)}
    item = np.array([number[row[0]] for row in block], np.int64)
    term, w, df = (np.array([row[c] for row in block], np.int64) for c in (1, 2, 3))
    order = np.lexsort((term, df, item))  # rarest first within an item
    item, term, w = item[order], term[order], w[order]
    edge = np.searchsorted(item, np.arange(len(ids) + 1)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = _Ranking(len(ids), k)
        for batch in batches:
            for row in range(batch.num_rows):
                lists = {name: batch.column(name)[row].values for name in ("docs", "lengths", "terms", "starts", "places", "counts")}
                docs = lists.pop("docs")
                lengths, terms, starts, places, counts = (v.to_numpy() for v in lists.values())
                if not len(terms):
                    continue
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                here = terms[at] == term
                m = 10 + 90 * lengths * documents // max(total, 1)
                tf = counts.astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
                for i in range(len(ids)):
                    on = np.flatnonzero(here[edge[i] : edge[i + 1]]) + edge[i]
                    if not len(on):
                        continue
                    spans = [slice(starts[x], starts[x + 1]) for x in at[on].tolist()]
                    found, scores, _ = rank_item(
                        term[on],
                        w[on],
                        [impact[s] for s in spans],
                        [places[s] for s in spans],
                        len(lengths),
                        k,
                        ranking.threshold(i),
                    )
                    if len(found):
                        ranking.add(i, scores, docs.take(pa.array(found)).to_pylist())
        out = [(ids[i], None if none else d, -s) for i, best in enumerate(ranking.best) for s, none, d in best]
        columns = [pa.array([r[c] for r in out], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return run


def lexical_top_k(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with score above 0.

    Equal scores rank by ascending doc_id, null last.  Null, empty and term-less texts hold nothing
    and count as no document; rows that repeat a doc_id are documents of their own.  Items that
    share an item_id (null too) are one item with the terms of all of them; an item without terms,
    or whose terms no document holds, has no rows, and so has an empty table.  Other columns play
    no part.  Items go over the index in blocks of about ``BLOCK_TERMS`` terms, so what a task and
    the driver hold does not grow with them (one item's terms are always together).
    """
    spark = docs.sparkSession
    shards = save(index_shards(docs), "shards", LARGE_ROWS)
    asked = save(weighted_items(items, shards), "items")
    corpus = shards.agg(F.sum("documents"), F.sum("total")).first()
    documents, total = (int(v or 0) for v in corpus)
    blocks = -(-asked.count() // BLOCK_TERMS)
    number = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    schema = "item_id long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = [tuple(r) for r in asked.where(number == block).collect()]
        if rows:
            part = shards.mapInArrow(_search(rows, documents, total, k), schema)
            with small_batches(spark):
                part = save(part, "ranked")
            found = found.union(part)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    group = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_GROUPS))
    some = Window.partitionBy("item_id", "part").orderBy(*order)
    first = (
        found.withColumn("part", group)
        .withColumn("place", F.row_number().over(some))
        .where(F.col("place") <= k)
        .drop("part", "place")
    )
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

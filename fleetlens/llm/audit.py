"""How quality filters interact: what each removes in every order, and its fair share of removals.

Every document gets a mask of the filters it fails, so a table of the removals of all coalitions of
filters (32 for five) says everything: the step counts of an order are differences of coalitions, and
the Shapley values solve a least squares problem over them, with kernel weights and the constraint
that they add up to the removals of all filters together.  The normal equations are linear in the
removals; they are solved in rationals once, for the removals of each coalition as a unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.words import text_slices

#: Filters that look at one text, in the order of the bits, and the one for copies.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
_CAPITALS = bytes(range(0x41, 0x5B))
_MARKS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    words = text.split()  # of bytes: at blank and 0x09-0x0D
    points = len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words),
        100 * capitals > MOST_CAPITALS_PERCENT * points,
        len(text.translate(None, _MARKS)) < len(text),
    )
    return sum(bit << i for i, bit in enumerate(failed))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in text_slices(batch.column(2)):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(begin, len(texts)),
                    batch.column(1).slice(begin, len(texts)),
                    pa.array([failures(t) for t in texts], pa.int32()),
                    pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts]),
                ],
                names=["doc_id", "part", "mask", "digest"],
            )


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of the failed filters A to D, and a 128-bit digest of the text."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    return narrow.mapInArrow(_judge, "doc_id long, part string, mask int, digest binary")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``: whether any label of the doc_id says so."""
    known = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
        .withColumn("_named", F.lit(True))
    )
    # Rows without doc_id have no label; the digest spreads them over the tasks of the join.
    keyed = rows.withColumn("_key", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn(
        "_known", F.col("doc_id").isNotNull()
    )
    joined = keyed.join(
        known, (F.col("_key") == F.col("_id")) & (F.col("_known") == F.col("_named")), "left"
    )
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return joined.select(*rows.columns, *flags)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per (part, mask over all filters): documents ``n``, of these ``good`` and ``toxic``.

    Copies of a text share all masks but that of the copy filter, so a text needs one row per part
    and label; the smallest doc_id of the table passes that filter, as often as it stands there.
    """
    once = judged(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    groups = (
        with_labels(once, labels)
        .groupBy("digest", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("unnamed"))
        .agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("low"))
    )
    # A digest has few rows here: one per part and label.
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    passing = F.when(F.col("unnamed"), F.col("n")).when(
        F.col("low.doc_id") == F.col("first"), F.col("low.n")
    ).otherwise(0)
    copy_bit = F.lit(1 << FILTERS.index("E"))
    split = (
        groups.withColumn("first", first)
        .withColumn("passing", passing)
        .select(
            "part",
            "good",
            "toxic",
            F.inline(
                F.array(
                    F.struct(F.col("mask"), F.col("passing").alias("n")),
                    F.struct(
                        F.col("mask").bitwiseOR(copy_bit).alias("mask"),
                        (F.col("n") - F.col("passing")).alias("n"),
                    ),
                )
            ),
        )
    )
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solution X of ``matrix X = right`` by exact elimination; the matrix is regular."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right, strict=True)]
    size = len(rows)
    for i in range(size):
        pivot = next(j for j in range(i, size) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        head = rows[i][i]
        rows[i] = [x / head for x in rows[i]]
        for j in range(size):
            if j != i and rows[j][i]:
                by = rows[j][i]
                rows[j] = [x - by * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [row[size:] for row in rows]


def shapley_weights(players: int) -> list[list[Fraction]]:
    """For each player, the weight of each coalition's value in its Shapley value.

    Least squares of the additive model over all coalitions but none and all, weighted by the
    Shapley kernel, under the constraint that the values add up to that of all players.  A Lagrange
    multiplier is the last unknown.
    """
    whole = (1 << players) - 1

    def kernel(coalition: int) -> Fraction:
        k = coalition.bit_count()
        return Fraction(players - 1, comb(players, k) * k * (players - k))

    weight = {s: kernel(s) for s in range(1, whole)}

    def moment(bits: int) -> Fraction:
        return sum((w for s, w in weight.items() if s & bits == bits), Fraction(0))

    one, none = Fraction(1), Fraction(0)
    matrix = [
        [moment(1 << i | 1 << j) for j in range(players)] + [one] for i in range(players)
    ] + [[one] * players + [none]]
    right = [
        [weight.get(s, none) if s >> i & 1 else none for s in range(whole + 1)]
        for i in range(players)
    ] + [[one if s == whole else none for s in range(whole + 1)]]
    return solve(matrix, right)[:players]


def _order_sums(removed: Column, players: int) -> list[Column]:
    """Per player, its removals summed over all orders, from the array of coalition removals."""
    sums = []
    for row in shapley_weights(players):
        scaled = [factorial(players) * x for x in row]
        below = lcm(*(x.denominator for x in scaled))
        terms = [int(x * below) * removed[s] for s, x in enumerate(scaled) if x]
        total = sum(terms[1:], terms[0])
        sums.append(total if below == 1 else F.call_function("div", total, F.lit(below)))
    return sums


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step: what the step's filter does.

    A part is a value of ``lang``; null and empty are one part.  Null texts count as empty.  A null
    doc_id is not smaller than any other and none is smaller than it, so the copy filter lets it
    pass, and it has no label.  A doc_id that stands in several rows counts once per row; with the
    same text in all, none is a copy of the other.  Labels that contradict count as good, as toxic.
    An empty table has no parts and gives no rows.  Other columns play no part.
    """
    players = len(FILTERS)
    coalitions = range(1 << players)
    whole = len(coalitions) - 1

    def removals(count: str) -> Column:
        hit = [F.when(F.col("mask").bitwiseAND(s) != 0, F.col(count)).otherwise(0) for s in coalitions]
        return F.array(*(F.sum(h) for h in hit))

    table = (
        mask_counts(docs, labels)
        .groupBy("part")
        .agg(
            F.sum("n").alias("documents"),
            *(removals(c).alias(f"of_{c}") for c in ("n", "good", "toxic")),
        )
    )
    sums = F.array(*_order_sums(F.col("of_n"), players)).alias("sums")
    steps = [
        F.struct(
            F.lit("".join(order)).alias("filter_order"),
            F.lit(step + 1).alias("step"),
            F.lit(FILTERS.index(name)).alias("player"),
            F.lit(sum(1 << FILTERS.index(f) for f in order[:step])).alias("before"),
        )
        for order in permutations(FILTERS)
        for step, name in enumerate(order)
    ]
    rows = table.select("*", sums).select("*", F.inline(F.array(*steps)))
    bit = F.call_function("shiftleft", F.lit(1), F.col("player"))
    after = F.col("before").bitwiseOR(bit)

    def lost(count: str) -> Column:
        values = F.col(f"of_{count}")
        return values[after] - values[F.col("before")]

    values = F.col("of_n")
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - values[after]).alias("kept"),
        lost("n").alias("removed"),
        (values[bit] - lost("n")).alias("redundant"),
        (values[whole] - values[F.lit(whole).bitwiseXOR(bit)]).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.col("sums")[F.col("player")].alias("shapley"),
    )

"""Synthetic data at scale from a small seed table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import int_div
from fleetlens.functions.text import concat_text
from fleetlens.operators.distributed import ordered_scan

# Copies per row, id distance of two copies, days of a series and its first day.
COPIES = 50
ID_STEP = 1000
SERIES_DAYS = 2048
SERIES_START = "2005-01-01"
LARGEST_GROUP = 26
#: Rows that one task makes, about.
TASK_ROWS = 1_000_000


def scale_up(
    df: DataFrame,
    id_col: str,
    n: int = COPIES,
    step: int = ID_STEP,
    labels: Mapping[str, str] | None = None,
    distinct_ids: bool = True,
) -> DataFrame:
    """``n`` copies of every row with ids moved by ``copy * step``.

    ``labels`` maps text columns to the separator put before their copy offset.  Rows are multiplied
    where they are; nothing is shuffled.  ``step`` must exceed the range of the ids, or copies would
    share ids; this is checked first, by one aggregate over the ids.  With ``distinct_ids=False`` all
    copies are wanted as they fall, and ids may repeat.
    """
    labels = dict(labels or {})
    if distinct_ids:
        low, high = df.agg(F.min(id_col), F.max(id_col)).first()
        if low is not None and high - low >= step:
            raise ValueError(f"ids span {high - low + 1}, copies {step} apart would collide")
    offset = F.col("_copy") * step
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    columns = []
    for c in df.columns:
        if c == id_col:
            columns.append((F.col(c) + offset).alias(c))
        elif c in labels:
            columns.append(concat_text(F.col(c), labels[c], offset.cast("string")).alias(c))
        else:
            columns.append(F.col(c))
    return copies.select(*columns)


def largest_divisor(value: Column, greatest: int = LARGEST_GROUP) -> Column:
    """The greatest divisor of ``value`` that is at most ``greatest`` (1 if there is no other)."""
    ladder = [F.when(value % d == 0, d) for d in range(greatest, 1, -1)]
    return F.coalesce(*ladder, F.lit(1))


def ntile_of(position: Column, rows: int, tiles: Column) -> Column:
    """Tile of the 1-based ``position`` among ``rows`` rows cut into ``tiles``, larger tiles first."""
    size = int_div(F.lit(rows), tiles)
    larger = F.lit(rows) % tiles
    boundary = larger * (size + 1)
    return F.when(position <= boundary, int_div(position - 1, size + 1) + 1).otherwise(
        larger + int_div(position - boundary - 1, size) + 1
    )


def sparse_dates(
    df: DataFrame,
    id_col: str,
    group: Column,
    days: int = SERIES_DAYS,
    start: str = SERIES_START,
) -> DataFrame:
    """Per id, the days in the odd tiles when ``days`` days are cut into ``group`` tiles.

    The tiles are computed in closed form, without a window per id, and only the days in them are
    made, in tasks of about ``TASK_ROWS`` days.
    """
    seeds = df.withColumn("_group", group.cast("int")).repartition(_tasks(df.count() * days), id_col)
    size, larger = int_div(F.lit(days), F.col("_group")), F.lit(days) % F.col("_group")
    odd = F.filter(F.sequence(F.lit(1), F.col("_group")), lambda t: t % 2 == 1)
    tiles = seeds.select(*df.columns, size.alias("_size"), larger.alias("_larger"), F.explode(odd).alias("_tile"))
    first = (F.col("_tile") - 1) * F.col("_size") + F.least(F.col("_tile") - 1, F.col("_larger"))
    length = F.col("_size") + (F.col("_tile") <= F.col("_larger")).cast("int")
    origin = F.lit(start).cast("date")
    spans = tiles.withColumns({"_first": first.cast("int"), "_length": length.cast("int")}).filter("_length > 0")
    return spans.select(
        *df.columns,
        F.explode(
            F.sequence(
                F.date_add(origin, F.col("_first")),
                F.date_add(origin, F.col("_first") + F.col("_length") - 1),
            )
        ).alias("transaction_date"),
    )


def _tasks(rows: int) -> int:
    """Tasks for rows made from few: the files of the seed say nothing of them."""
    return max(1, -(-rows // TASK_ROWS))


def _hashed_unit(*parts) -> Column:
    """A number in [0, 1) from the hash of the parts; the same on every run."""
    return F.call_function("shiftrightunsigned", F.xxhash64(*parts), F.lit(11)) / F.lit(2.0**53)


def sparse_series(
    df: DataFrame,
    id_col: str,
    price_col: str,
    days: int = SERIES_DAYS,
    start: str = SERIES_START,
    seed: int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Random transactions on the sparse days of every id, numbered by date, then id.

    Quantities are 1 to 100, costs up to twice the list price; both are hashes of id and day, so
    reruns agree.  ``transaction_id`` runs without gaps over all rows.  It is counted, not sorted:
    which groups are active on a day is known from the calendar, so the rows of all days before
    follow from the sizes of the ``LARGEST_GROUP`` groups, and the rows of the same day before an id
    from how many ids of each group come before it.  Only the ids are put in order.  The calendar is
    cut into runs of days with the same active groups; an id gets its first number of a run, and its
    days of the run follow in equal steps.  Rows stay with their id, dealt by its hash to tasks of
    about ``TASK_ROWS``, so a grouping by id needs no shuffle.  ``keep`` names further columns of
    ``df`` that each row shall carry.
    """
    groups = range(1, LARGEST_GROUP + 1)
    carried = list(dict.fromkeys([id_col, price_col, *keep]))
    one = df.select(*carried).withColumn("_group", largest_divisor(F.col(id_col)))
    flags = {f"_is_{g}": (F.col("_group") == g).cast("bigint") for g in groups}
    ids = ordered_scan(
        one.withColumns(flags), [], [id_col], before={f"_before_{g}": f"_is_{g}" for g in groups}
    )
    sizes = {r["_group"]: r["count"] for r in one.groupBy("_group").count().collect()}
    # A row per day of the calendar: the groups that are active on it.
    calendar = one.sparkSession.range(days).select(
        "id", *[(ntile_of(F.col("id") + 1, days, F.lit(g)) % 2 == 1).alias(f"g{g}") for g in groups]
    )
    active = [[g for g in groups if r[f"g{g}"]] for r in calendar.orderBy("id").collect()]
    offset, runs = 0, []
    for day, on in enumerate(active):
        mask, per_day = sum(1 << g for g in on), sum(sizes.get(g, 0) for g in on)
        if runs and runs[-1]["mask"] == mask:
            runs[-1]["length"] += 1
        else:
            runs.append({"first": day, "length": 1, "mask": mask, "offset": offset, "per_day": per_day})
        offset += per_day
    kind = "array<struct<first: int, length: int, mask: bigint, offset: bigint, per_day: bigint>>"
    calendar_runs = F.from_json(F.lit(json.dumps(runs)), kind)

    def is_on(mask: Column, g: int | Column) -> Column:
        return F.call_function("bit_get", mask, g if isinstance(g, Column) else F.lit(g)).cast("bigint")

    own = F.filter(calendar_runs, lambda r: is_on(r["mask"], F.col("_group")) == 1)
    same_day = reduce(add, [F.col(f"_before_{g}") * is_on(F.col("_run.mask"), g) for g in groups])
    dated = (
        ids.repartition(_tasks(offset), id_col)
        .withColumn("_run", F.explode(own))
        .select(
            *carried, "_run.first", "_run.length", "_run.per_day",
            (F.col("_run.offset") + same_day + 1).alias("_start"),
        )
        .withColumn(
            "transaction_id",
            F.explode(
                F.sequence(
                    F.col("_start"),
                    F.col("_start") + (F.col("length") - 1) * F.col("per_day"),
                    F.col("per_day"),
                )
            ),
        )
        .withColumn(
            "_day", F.col("first") + int_div(F.col("transaction_id") - F.col("_start"), F.col("per_day")).cast("int")
        )
    )
    quantity = (F.pmod(F.xxhash64(id_col, "_day", F.lit(seed)), F.lit(100)) + 1).cast("int")
    share = _hashed_unit(id_col, "_day", F.lit(seed + 1))
    return dated.withColumn("quantity", quantity).select(
        "transaction_id",
        id_col,
        F.date_add(F.lit(start).cast("date"), F.col("_day")).alias("transaction_date"),
        "quantity",
        (F.col(price_col) * F.col("quantity") * share * 2).cast("decimal(19,4)").alias("actual_cost"),
        *keep,
    )

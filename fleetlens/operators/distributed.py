"""Building blocks that keep ordered and top-1 work spread over the cluster.

A window whose ``PARTITION BY`` is empty, or whose key may hold a large share of all rows, runs in
one task.  The functions here give the same numbers without that task.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.numbers import micros_of

#: Largest lookup that may be broadcast (rows); larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a slice of an ordered scan, about, and how many slices there may be before they grow.
SLICE_ROWS = 200_000
MOST_SLICES = 4096
#: A column in ascending order, or a column and whether it descends.
Order = str | tuple[str, bool]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local session without that
    setting gets a fresh folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="fleetlens-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the checkpoint folder and read again.

    For the costly input of a step that reads it several times, as :func:`ordered_scan` does.  The
    folder belongs to the owner of ``spark.checkpoint.dir``; tables are not removed here.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``limit`` rows, else unchanged.

    The check reads at most ``limit + 1`` rows.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sized_for_join(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``limit`` rows, else with one for a shuffle.

    For the side of a join whose rows are made from fewer ones.  Spark estimates its size from the
    files, so it would broadcast, through the driver, a table that is small only in the files.
    """
    small = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if small else df.hint("merge")


def all_of(*conditions: Column) -> Column:
    """Conjunction of the conditions (TRUE when there is none)."""
    result = F.lit(True)
    for i, condition in enumerate(conditions):
        result = condition if i == 0 else result & condition
    return result


def _exclusive(order: Sequence[Column | str], keys: Sequence[str]) -> Window:
    return (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _comparable(df: DataFrame, name: str) -> Column:
    """A column in a form that a literal can hold exactly, in the same order."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros_of(name, kind)
    return F.unix_date(name) if isinstance(kind, T.DateType) else F.col(name)


def _precedes(left: Column, right: Column, descending: Sequence[bool]) -> Column:
    """Whether the struct ``left`` comes before ``right``: NULL first ascending, last descending."""
    result = F.lit(False)
    for i, down in reversed(list(enumerate(descending))):
        x, y = left[f"f{i}"], right[f"f{i}"]
        low, high = (y, x) if down else (x, y)
        less = F.coalesce(low < high, low.isNull() & high.isNotNull())
        result = less | (x.eqNullSafe(y) & result)
    return result


def slice_number(
    df: DataFrame, order: Sequence[Order], slice_rows: int = SLICE_ROWS
) -> Column | None:
    """The number of the slice a row is in, when ``df`` is cut in ``order`` into slices of about
    ``slice_rows`` rows; None where one slice is enough.

    The bounds are those rows whose hash is divisible by the size of a slice, so they depend on the
    content alone.  They are literals: a recomputed task cuts where the lost one did.  There are
    about ``MOST_SLICES`` of them at most; beyond, slices grow.
    """
    fields = [(c, False) if isinstance(c, str) else c for c in order]
    narrow = df.select(*[_comparable(df, c).alias(f"f{i}") for i, (c, _) in enumerate(fields)])
    rows = narrow.count()
    if rows <= slice_rows:
        return None
    every = max(slice_rows, rows // MOST_SLICES)
    chosen = narrow.filter(F.pmod(F.xxhash64(*narrow.columns), F.lit(every)) == 0).distinct()
    down = [d for _, d in fields]
    found = chosen.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in zip(narrow.columns, down)])
    listed = [r.asDict() for r in found.collect()]
    if not listed:
        return None
    text = json.dumps(listed, default=str)
    bounds = F.from_json(F.lit(text), T.ArrayType(narrow.schema))
    here = F.struct(*[_comparable(df, c).alias(f"f{i}") for i, (c, _) in enumerate(fields)])
    steps = [1 << i for i in reversed(range(len(listed).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        beyond = (at + step <= len(listed)) & ~_precedes(here, F.get(bounds, at + step - 1), down)
        return F.when(beyond, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Order],
    before: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    position: str | None = None,
    bounded: bool = False,
    slice_rows: int = SLICE_ROWS,
    until: Column | None = None,
) -> DataFrame:
    """Row positions and running sums per key, in a total order.

    ``order`` (names, or pairs of a name and whether it descends) must be unique within a key.
    ``position`` names a 1-based row number; ``before`` maps output names to columns summed over the
    rows *before* the current one; ``totals`` maps output names to columns summed over the whole key.
    ``until`` is a condition on the ``before`` and ``totals`` columns that, once false, stays false
    for the rest of a key: slices behind that place are left out unsorted.

    ``bounded=True`` states that one key's rows fit one task by construction of the data (for
    example the wait types of one server) and uses a plain window, as is done for a table of one
    slice.  Otherwise the rows are cut into slices (:func:`slice_number`), so even a single key is
    spread over many tasks; the small table of slice sums supplies the offsets, and each slice is
    scanned on its own.  Nothing is written: the slices can be recomputed.
    """
    before, totals = dict(before or {}), dict(totals or {})
    keys = list(keys)
    sort = [F.asc(c) if isinstance(c, str) else (F.desc(c[0]) if c[1] else F.asc(c[0])) for c in order]
    number = None if bounded else slice_number(df, [*keys, *order], slice_rows)
    if number is None:
        per_key = Window.partitionBy(*keys)
        columns = {n: F.coalesce(F.sum(c).over(_exclusive(sort, keys)), F.lit(0))
                   for n, c in before.items()}
        columns |= {n: F.sum(c).over(per_key) for n, c in totals.items()}
        if position:
            columns[position] = F.row_number().over(per_key.orderBy(*sort)).cast("bigint")
        return df.withColumns(columns)

    sliced = df.withColumn("_slice", number)
    summed = sorted(set(before.values()) | set(totals.values()))
    sums = [F.sum(c).alias(f"_sum_{i}") for i, c in enumerate(summed)]
    slices = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"), *sums)
    # One row per key and slice; a key spans at most as many slices as there are bounds.
    earlier = _exclusive(["_slice"], keys)
    index = {c: f"_sum_{i}" for i, c in enumerate(summed)}
    offsets = slices.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row_offset"),
        *[F.coalesce(F.sum(index[c]).over(earlier), F.lit(0)).alias(n) for n, c in before.items()],
        *[F.sum(index[c]).over(Window.partitionBy(*keys)).alias(n) for n, c in totals.items()],
    )
    if until is not None:
        offsets = offsets.filter(until)
    in_slice = [*keys, "_slice"]
    added = {n: f"_offset_{n}" for n in [*before, *totals]}
    other = offsets.withColumnsRenamed({c: f"_o{c}" for c in in_slice} | added)
    joined = sliced.join(other, all_of(*[F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in in_slice]))
    local = {
        f"_before_{n}": F.coalesce(F.sum(c).over(_exclusive(sort, in_slice)), F.lit(0))
        for n, c in before.items()
    }
    if position:
        local["_local"] = F.row_number().over(Window.partitionBy(*in_slice).orderBy(*sort))
    out = [F.col(c) for c in df.columns]
    out += [(F.col(f"_offset_{n}") + F.col(f"_before_{n}")).alias(n) for n in before]
    out += [F.col(f"_offset_{n}").alias(n) for n in totals]
    if position:
        out.append((F.col("_row_offset") + F.col("_local")).alias(position))
    return joined.withColumns(local).select(*out)


def top_n(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order``, of each key where there are ``keys``.

    Per key every task keeps ``n`` rows before the shuffle, so a hot key is no large group.
    """
    if not keys:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values per key (NULLs last), ties by the other columns.

    An aggregate rather than a ranking window: every map task emits one row per key, so a key with
    a third of all rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    winner = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(winner).select(
        *keys, *[F.col("_best")[c].alias(c) for c in df.columns if c not in keys]
    )

"""Threshold alerts with a cooldown over a whole history.

Whether a row raises an alert depends on the alert before it, so the rows of a key form a chain.  It
is cut into time slices no shorter than the cooldown.  What a slice does to the chain is a function
of the time from which it may alert again, with one step per row in the first cooldown of the slice
at most.  The functions of neighbouring slices are linked by pointers from step to step; pointers
are doubled until they pass the longest run of slices, and then walked back down to find how each
slice is entered.  So every task holds one slice of one key, and a long history needs as many rounds
as the logarithm of its slices.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.numbers import from_micros, micros_of
from fleetlens.operators.distributed import all_of, ensure_checkpoint_dir

_OPERATORS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le,
              "=": operator.eq}
#: The step of a slice that is entered behind its last row.
_BEHIND = np.iinfo(np.int64).max
_DAY = 86_400_000_000


def greedy_thinning(us: np.ndarray, cooldown_us: int, start: int) -> np.ndarray:
    """Positions in the sorted times ``us`` that alert: the first one from ``start`` on, then each
    first one at least ``cooldown_us`` behind the alert before it."""
    following = np.searchsorted(us, us + cooldown_us).tolist() if cooldown_us > 0 else list(range(1, len(us) + 1))
    at, chosen = int(np.searchsorted(us, start)), []
    while at < len(us):
        chosen.append(at)
        at = following[at]
    return np.array(chosen, dtype=np.int64)


def slice_steps(us: np.ndarray, cooldown_us: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The function of a slice: entering it up to time ``hi`` lets it go at time ``free``.

    ``hi`` ascends; a time beyond the last row leaves the slice without an alert.  The slice cannot
    be entered later than one cooldown after its begin.
    """
    following = np.searchsorted(us, us + cooldown_us)
    last = np.where(following < len(us), np.minimum(following, len(us) - 1), np.arange(len(us)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    free = us[last] + cooldown_us
    reach = int(np.searchsorted(us, begin + cooldown_us)) + 1
    hi, free = us[:reach], free[:reach]
    if reach > len(us):
        hi, free = np.append(hi, _BEHIND), np.append(free, end)
    kept = np.append(free[1:] != free[:-1], True)
    return hi[kept], free[kept]


def threshold_alerts(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    metric: str,
    op: str = ">",
    threshold: float = 50.0,
    cooldown_s: float = 10.0,
    slice_s: float | None = None,
) -> DataFrame:
    """Rows whose metric crosses the threshold, at most one per key and cooldown, in time order.

    The first crossing row of a key alerts, then each first one at least ``cooldown_s`` after the
    alert before it.  Of rows of one time the greatest metric counts; rows without time or metric
    never alert.  ``slice_s`` (a day, but at least the cooldown) is how much of one key's history a
    task holds.
    """
    keys = list(keys)
    cooldown = int(cooldown_s * 1_000_000)
    width = max(int(slice_s * 1_000_000) if slice_s else _DAY, cooldown, 1)
    kind = df.schema[ts].dataType
    rows = (
        df.select(*keys, micros_of(ts, kind).alias("us"), F.col(metric).cast("double").alias("value"))
        .filter(F.col("us").isNotNull() & _OPERATORS[op](F.col("value"), F.lit(threshold)))
        .groupBy(*keys, "us")
        .agg(F.max("value").alias("value"))
        .withColumn("part", _floor_div("us", width))
    )
    alerting = _entered(rows, keys, cooldown, width) if cooldown > 0 else rows
    return alerting.select(
        *keys,
        from_micros("us", kind).alias(ts),
        F.col("value").alias(metric),
        F.lit(op).alias("op"),
        F.lit(float(threshold)).alias("threshold"),
    )


def _floor_div(column: str, by: int) -> Column:
    return F.expr(f"({column} - pmod({column}, {by}L)) div {by}L")


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return all_of(*[F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _frozen(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _entered(rows: DataFrame, keys: list[str], cooldown: int, width: int) -> DataFrame:
    fields = [rows.schema[k] for k in keys]
    long = T.LongType()
    place = [*keys, "part"]

    def steps(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        part = int(key[-1])
        us = np.sort(group["us"].to_numpy())
        hi, free = slice_steps(us, cooldown, part * width, (part + 1) * width)
        return pd.DataFrame(dict(zip(place, key)) | {"hi": hi, "free": free}, columns=[*place, "hi", "free"])

    step_schema = T.StructType([*fields, *(T.StructField(n, long) for n in ("part", "hi", "free"))])
    nodes = _frozen(rows.groupBy(*place).applyInPandas(steps, step_schema))

    def link(key: tuple, before: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        """From the steps of the slice before to those of this one."""
        names = [*place, "hi", "to_part", "to_hi", "entry"]
        if not len(before) or not len(here):
            return pd.DataFrame(columns=names)
        his = np.sort(here["hi"].to_numpy())
        entry = before["free"].to_numpy()
        # A slice without a row behind the first cooldown has a step for every entry.
        to = his[np.searchsorted(his, entry)]
        part = int(key[-1])
        columns = dict(zip(keys, key)) | {"part": part - 1, "hi": before["hi"].to_numpy()}
        return pd.DataFrame(columns | {"to_part": part, "to_hi": to, "entry": entry}, columns=names)

    link_schema = T.StructType(
        [*fields, *(T.StructField(n, long) for n in ("part", "hi", "to_part", "to_hi", "entry"))]
    )
    ahead = nodes.withColumn("part", F.col("part") + 1)
    links = _frozen(
        ahead.groupBy(*place).cogroup(nodes.groupBy(*place)).applyInPandas(link, link_schema)
    )
    # levels[j]: 2^j slices further on.
    levels = []
    while not links.isEmpty():
        levels.append(links)
        first, second = links.alias("a"), links.alias("b")
        meet = all_of(
            *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys],
            F.col("a.to_part") == F.col("b.part"),
            F.col("a.to_hi") == F.col("b.hi"),
        )
        links = _frozen(
            first.join(second, meet).select(
                *[f"a.{k}" for k in keys], "a.part", "a.hi", "b.to_part", "b.to_hi", "b.entry"
            )
        )
    # A run of slices is entered freely, at its first step.
    firsts = nodes.groupBy(*place).agg(F.min("hi").alias("hi"))
    after = nodes.select(*keys, (F.col("part") + 1).alias("part")).distinct()
    entries = firsts.alias("a").join(after.alias("b"), _same("a", "b", place), "left_anti").select(
        "*", F.lit(np.iinfo(np.int64).min).cast("long").alias("entry")
    )
    for level in reversed(levels):
        reached = entries.alias("a").join(level.alias("b"), _same("a", "b", [*place, "hi"])).select(
            *[f"b.{k}" for k in keys],
            F.col("b.to_part").alias("part"),
            F.col("b.to_hi").alias("hi"),
            F.col("b.entry").alias("entry"),
        )
        entries = _frozen(entries.union(reached))

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("us")
        chosen = greedy_thinning(ordered["us"].to_numpy(), cooldown, int(ordered["entry"].iloc[0]))
        return ordered.iloc[chosen][[*keys, "us", "value"]]

    known = rows.alias("a").join(entries.alias("b"), _same("a", "b", place)).select(
        "a.*", F.col("b.entry").alias("entry")
    )
    out = T.StructType([*fields, T.StructField("us", long), T.StructField("value", T.DoubleType())])
    return known.groupBy(*place).applyInPandas(thin, out)

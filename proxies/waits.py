"""Waits: a wait type is a user and an event type, its time the value of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import waits
from fleetlens.plans import waits_between
from proxies.base import instant, load, query, sql_cents, sql_ratio
from proxies.counters import (
    FIRST,
    SECOND,
    SQL_SNAPSHOTS,
    event_counters,
    event_snapshot,
    landed_snapshots,
    sql_snapshot,
)

def _name():
    return F.concat_ws(":", F.col("user_id").cast("string"), "event_type")


_SQL_NAME = "CAST(user_id AS VARCHAR) || ':' || event_type"


def wait_snapshot(spark, sf: str, before: str) -> DataFrame:
    return event_snapshot(spark, sf, before).withColumn("wait_type", _name()).drop(
        "user_id", "event_type"
    )


def wait_pair(spark, sf: str) -> DataFrame:
    """Both snapshots side by side, from a single scan of the events."""
    first, second = F.col("ts") < instant(FIRST), F.col("ts") < instant(SECOND)
    sources = {"waiting_tasks_count": "one", "wait_time_ms": "c", "signal_wait_time_ms": "g"}
    return (
        event_counters(spark, sf)
        .groupBy("user_id", "event_type")
        .agg(
            F.bool_or(first).alias("has_before"),
            F.bool_or(second).alias("has_after"),
            *[F.sum(F.when(first, F.col(c))).alias(f"before_{n}") for n, c in sources.items()],
            *[F.sum(F.when(second, F.col(c))).alias(f"after_{n}") for n, c in sources.items()],
        )
        .withColumn("wait_type", _name())
        .drop("user_id", "event_type")
    )


@query(
    "exclude_benign",
    """SELECT event_id, user_id, event_type FROM events
       WHERE event_type NOT IN ('signup', 'view')""",
)
def exclude_benign(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    return waits.exclude_benign(rows, "event_type", ["signup", "view"])


#: Wait types that the events stand for; three of them are in the shipped list of idle waits.
NAMED_WAITS = {
    "click": "LAZYWRITER_SLEEP",
    "view": "PAGEIOLATCH_SH",
    "error": "XE_TIMER_EVENT",
    "signup": "SLEEP_TASK",
}
_SQL_NAMED = f"CASE event_type {' '.join(f"WHEN '{e}' THEN '{w}'" for e, w in NAMED_WAITS.items())} ELSE 'WRITELOG' END"


def named_waits(column: str = "event_type"):
    named = F.lit("WRITELOG")
    for event, wait in NAMED_WAITS.items():
        named = F.when(F.col(column) == event, wait).otherwise(named)
    return named


@query(
    "exclude_benign_shipped",
    f"""SELECT event_id, {_SQL_NAMED} AS wait_type FROM events
       WHERE event_type NOT IN ('click', 'error', 'signup')""",
)
def exclude_benign_shipped(spark, sf):
    rows = load(spark, sf, "events").select("event_id", named_waits().alias("wait_type"))
    return waits.exclude_benign(rows)


def _sql_pareto(keys: str, name: str, source: str, threshold: int) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    out = f"{keys}, " if keys else ""
    return f"""WITH t AS ({source}),
    r AS (SELECT *, row_number() OVER (w) AS row_num, sum(v) OVER ({part}) AS total,
            coalesce(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavier
          FROM t WINDOW w AS ({part}ORDER BY v DESC, {name}))
    SELECT {out}{name}, v, row_num, {sql_ratio('v', 'total', 5, 2, 100)} AS percentage
    FROM r WHERE heavier * 100 < total * {threshold}"""


@query(
    "pareto",
    _sql_pareto(
        "", "o_custkey",
        f"SELECT o_custkey, CAST(sum({sql_cents('o_totalprice')}) AS BIGINT) AS v FROM orders "
        "GROUP BY o_custkey", 95,
    ),
)
def pareto(spark, sf):
    totals = (
        load(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("v"))
    )
    return waits.pareto(totals, [], "o_custkey", "v")


@query(
    "pareto_by_key",
    _sql_pareto(
        "event_type", "user_id",
        f"SELECT event_type, user_id, CAST(sum({sql_cents('value')}) AS BIGINT) AS v FROM events "
        "GROUP BY event_type, user_id", 80,
    ),
)
def pareto_by_key(spark, sf):
    totals = event_counters(spark, sf).groupBy("event_type", "user_id").agg(F.sum("c").alias("v"))
    return waits.pareto(totals, ["event_type"], "user_id", "v", threshold=80)


def _sql_profile(source: str, keys: str = "", extra: str = "", benign: str = "TRUE") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    out = f"{keys}, " if keys else ""
    seconds = {n: sql_ratio(c, "1000", 16, 2) for n, c in
               (("wait_s", "w"), ("resource_s", "w - g"), ("signal_s", "g"))}
    averages = {n: sql_ratio(c, "n * 1000", 16, 4) for n, c in
                (("avg_wait_s", "w"), ("avg_res_s", "w - g"), ("avg_sig_s", "g"))}
    return f"""{source},
    r AS (SELECT *, row_number() OVER (o) AS row_num, sum(w) OVER ({part}) AS total,
            coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavier
          FROM d WHERE {benign} WINDOW o AS ({part}ORDER BY w DESC, wait_type))
    SELECT {out}wait_type, {', '.join(f'{e} AS {n}' for n, e in seconds.items())},
      n AS wait_count, {sql_ratio('w', 'total', 5, 2, 100)} AS percentage,
      {', '.join(f'{e} AS {n}' for n, e in averages.items())}, row_num{extra}
    FROM r WHERE heavier * 100 < total * 95"""


@query(
    "wait_profile",
    _sql_profile(
        f"WITH {sql_snapshot('a', SECOND)}, d AS (SELECT *, {_SQL_NAME} AS wait_type FROM a)",
        extra=", 'https://www.sqlskills.com/help/waits/' || wait_type AS help_url",
        benign="wait_type NOT IN ('0:click', '1:view')",
    ),
)
def wait_profile(spark, sf):
    return waits.wait_profile(
        wait_snapshot(spark, sf, SECOND), benign=["0:click", "1:view"], bounded=False
    )


@query(
    "wait_profile_shipped",
    _sql_profile(
        f"WITH {sql_snapshot('a', SECOND)}, d AS (SELECT user_id AS server, {_SQL_NAMED} AS wait_type, n, w, g FROM a)",
        keys="server",
        extra=", 'https://www.sqlskills.com/help/waits/' || wait_type AS help_url",
        benign="wait_type IN ('PAGEIOLATCH_SH', 'WRITELOG')",
    ),
)
def wait_profile_shipped(spark, sf):
    stats = event_snapshot(spark, sf, SECOND).select(
        F.col("user_id").alias("server"), named_waits().alias("wait_type"), *waits.WAIT_COUNTERS
    )
    return waits.wait_profile(stats, ["server"])


_DIFF = f"""{SQL_SNAPSHOTS},
    d AS (SELECT DISTINCT user_id, event_type, {_SQL_NAME} AS wait_type,
            a.n - coalesce(b.n, 0) AS n, a.w - coalesce(b.w, 0) AS w, a.g - coalesce(b.g, 0) AS g
          FROM a LEFT JOIN b USING (user_id, event_type)
          WHERE (b.n IS NULL AND a.w > 0) OR (a.n > b.n AND a.w > b.w))"""


@query(
    "wait_diff",
    f"""{_DIFF} SELECT wait_type, n AS waiting_tasks_count, w AS wait_time_ms,
        g AS signal_wait_time_ms FROM d""",
)
def wait_diff(spark, sf):
    return waits.wait_diff(wait_snapshot(spark, sf, FIRST), wait_snapshot(spark, sf, SECOND))


@query("wait_profile_interval", _sql_profile(_DIFF))
def wait_profile_interval(spark, sf):
    diff = waits.wait_diff_of_pair(wait_pair(spark, sf))
    return waits.wait_profile_interval(diff, bounded=False)


@query(
    "waits_between",
    _sql_profile(
        _DIFF.replace(
            f"{_SQL_NAME} AS wait_type",
            "event_type AS server, 'USER_' || CAST(user_id AS VARCHAR) AS wait_type",
        ),
        keys="server",
    ),
)
def waits_per_server(spark, sf):
    landed = landed_snapshots(spark, sf).select(
        F.col("event_type").alias("server"),
        F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("wait_type"),
        "snapshot_ts",
        *waits.WAIT_COUNTERS,
    )
    return waits_between(landed, instant(FIRST), instant(SECOND), bounded=False)

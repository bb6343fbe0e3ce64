"""Query workload: top consumers, tuning recommendations, running work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.numbers import int_div, ratio, seconds_between
from fleetlens.functions.text import hour_min_sec, statement_text
from fleetlens.operators.distributed import best_row, top_n

# The commands whose progress is reported.
LONG_COMMANDS = [
    "RESTORE DATABASE",
    "BACKUP DATABASE",
    "RESTORE LOG",
    "BACKUP LOG",
    "RESTORE HEADERONLY",
]

_PLAN_FORCE_DETAILS = T.StructType(
    [
        T.StructField("queryId", T.IntegerType()),
        T.StructField("regressedPlanId", T.IntegerType()),
        T.StructField("recommendedPlanId", T.IntegerType()),
        T.StructField("regressedPlanErrorCount", T.IntegerType()),
        T.StructField("recommendedPlanErrorCount", T.IntegerType()),
        T.StructField("regressedPlanExecutionCount", T.IntegerType()),
        T.StructField("regressedPlanCpuTimeAverage", T.DoubleType()),
        T.StructField("recommendedPlanExecutionCount", T.IntegerType()),
        T.StructField("recommendedPlanCpuTimeAverage", T.DoubleType()),
    ]
)
_DETAILS = T.StructType(
    [
        T.StructField(
            "implementationDetails", T.StructType([T.StructField("script", T.StringType())])
        ),
        T.StructField("planForceDetails", _PLAN_FORCE_DETAILS),
    ]
)


def lateral_top1(
    left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Each left row with its single best right row; left rows without a match are dropped.

    ``order`` lists right columns, greatest first with NULLs last; remaining ties are broken by the
    other right columns.  The right side is reduced to one row per key before the join.
    """
    return left.join(best_row(right, on, order), list(on))


def top_cpu_missing_index(
    stats: DataFrame,
    texts: DataFrame,
    plans: DataFrame,
    missing: DataFrame,
    n: int = 50,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` statements (of each key) with the greatest peak CPU time that have a missing-index hint."""
    hints = missing.withColumnRenamed("last_sql_handle", "sql_handle")
    on = [*keys, "query_hash", "query_plan_hash", "sql_handle"]
    # Only whether a hint exists matters for the output, so the apply is a semi join.
    hinted = stats.join(hints.select(*on), on, "left_semi")
    found = hinted.join(texts.select(*keys, "sql_handle", "text"), [*keys, "sql_handle"]).join(
        plans.select(*keys, "plan_handle", "query_plan"), [*keys, "plan_handle"]
    )
    order = [F.desc("max_worker_time"), F.col("sql_handle"), F.col("statement_start_offset")]
    top = top_n(found, n, order, keys)
    return top.select(
        *keys,
        "sql_handle",
        statement_text("text", "statement_start_offset", "statement_end_offset").alias(
            "query_text"
        ),
        "query_plan",
        "creation_time",
        "last_execution_time",
        "execution_count",
        "max_worker_time",
        int_div("total_worker_time", "execution_count").alias("avg_worker_time"),
        "max_grant_kb",
        "max_used_grant_kb",
        "total_spills",
    )


def querystore_top_cpu(
    runtime: DataFrame,
    plan: DataFrame,
    query: DataFrame,
    text: DataFrame,
    missing: DataFrame,
    asof: Column,
    days: int = 7,
    min_cpu_us: int = 10_000,
    n: int = 100,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` most CPU-hungry recent plans (of each key), then only those that have a missing-index hint.

    The cut to ``n`` comes before the hint is looked up, so fewer rows may remain.
    """
    recent = runtime.filter(
        (F.col("last_execution_time") >= asof - F.make_dt_interval(F.lit(days)))
        & (F.col("avg_cpu_time") >= min_cpu_us)
    )
    plans = plan.filter(~F.col("is_online_index_plan")).select(
        *keys, "plan_id", "query_id", "query_plan", "query_plan_hash"
    )
    queries = query.filter(~F.col("is_internal_query")).select(
        *keys, "query_id", "query_text_id", "query_hash", "object_name"
    )
    found = (
        recent.join(plans, [*keys, "plan_id"])
        .join(queries, [*keys, "query_id"])
        .join(text.select(*keys, "query_text_id", "query_sql_text"), [*keys, "query_text_id"])
    )
    newest = [F.desc("avg_cpu_time"), F.desc("last_execution_time")]
    top = top_n(found, n, [*newest, F.col("plan_id"), F.col("count_executions")], keys)
    # The hint itself is not shown: the apply only keeps rows that have one.
    on = [*keys, "query_hash", "query_plan_hash"]
    hinted = top.join(missing.select(*on), on, "left_semi")
    return hinted.select(
        *keys,
        F.coalesce("object_name", F.lit("No Parent Object")).alias("parent_object_name"),
        "query_sql_text",
        "query_plan",
        "plan_id",
        "first_execution_time",
        "last_execution_time",
        "count_executions",
        "avg_duration",
        "avg_cpu_time",
        "query_plan_hash",
        "query_hash",
    ).orderBy(F.desc("avg_cpu_time"), F.desc("last_execution_time"), "plan_id")


def tuning_recommendations(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Plan-forcing recommendations from their JSON details, with the estimated CPU gain.

    Recommendations without plan-forcing details are dropped.
    """
    parsed = df.withColumn("_d", F.from_json("details", _DETAILS)).filter(
        F.col("_d.planForceDetails").isNotNull()
    )
    p = {f.name: F.col(f"_d.planForceDetails.{f.name}") for f in _PLAN_FORCE_DETAILS}
    executions = p["regressedPlanExecutionCount"] + p["recommendedPlanExecutionCount"]
    saved = p["regressedPlanCpuTimeAverage"] - p["recommendedPlanCpuTimeAverage"]
    return parsed.select(
        *keys,
        "reason",
        "score",
        F.col("_d.implementationDetails.script").alias("script"),
        p["queryId"].alias("query_id"),
        p["regressedPlanId"].alias("new_plan_id"),
        p["recommendedPlanId"].alias("recommended_plan_id"),
        (executions * saved / 1_000_000).alias("estimated_gain"),
    )


def running_requests(
    requests: DataFrame, texts: DataFrame, asof: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Backups and restores in progress: elapsed time, time to go, expected end."""
    to_go_s = int_div("estimated_completion_time", 1000)
    return (
        requests.filter(F.col("command").isin(*LONG_COMMANDS))
        .join(texts.select(*keys, "sql_handle", "text"), [*keys, "sql_handle"])
        .select(
            *keys,
            "session_id",
            "command",
            "text",
            "start_time",
            "percent_complete",
            hour_min_sec(seconds_between("start_time", asof)).alias("running_time"),
            hour_min_sec(to_go_s).alias("est_time_to_go"),
            (asof + F.make_dt_interval(secs=to_go_s)).alias("est_completion_time"),
        )
    )


def seeding_progress(df: DataFrame, tz: str = "UTC", keys: Sequence[str] = ()) -> DataFrame:
    """Progress of automatic seeding; UTC times are shown in the time zone ``tz``."""

    def mb(name: str) -> Column:
        return int_div(int_div(name, 1024), 1024)

    def local(name: str) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(name).cast("timestamp_ntz"))

    return df.select(
        *keys,
        "local_database_name",
        "remote_machine_name",
        F.col("role_desc").alias("role"),
        mb("transfer_rate_bytes_per_second").alias("mb_per_second"),
        mb("transferred_size_bytes").alias("transferred_size_mb"),
        mb("database_size_bytes").alias("database_size_mb"),
        # Wide enough for whatever the two counters give: the size may lag far behind the transfer.
        ratio("transferred_size_bytes", "database_size_bytes", 20, 2, factor=100).alias(
            "percent_done"
        ),
        local("start_time_utc").alias("start_time"),
        local("estimate_time_complete_utc").alias("estimate_time_complete"),
        "total_disk_io_wait_time_ms",
        "total_network_wait_time_ms",
        "is_compression_enabled",
    )


__all__ = [
    "LONG_COMMANDS",
    "lateral_top1",
    "querystore_top_cpu",
    "running_requests",
    "seeding_progress",
    "statement_text",
    "top_cpu_missing_index",
    "tuning_recommendations",
]

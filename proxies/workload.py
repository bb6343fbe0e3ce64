"""Query workload: orders and line items as statements, events as requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.text import statement_text
from fleetlens.operators import workload
from proxies.base import cents, derive, instant, load, query, sql_cents, sql_columns, sql_ratio


@query(
    "lateral_top1",
    """SELECT c_custkey, c_name, o_totalprice, o_orderdate, o_orderkey
    FROM customer JOIN LATERAL (SELECT * FROM orders WHERE o_custkey = c_custkey
      ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC LIMIT 1) ON TRUE""",
)
def lateral_top1(spark, sf):
    customers = load(spark, sf, "customer").select("c_custkey", "c_name")
    orders = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderdate", "o_orderkey"
    )
    return workload.lateral_top1(customers, orders, ["c_custkey"], ["o_totalprice", "o_orderdate"])


STATS = {
    "query_hash": "o_custkey",
    "query_plan_hash": "o_orderpriority",
    "sql_handle": "o_orderkey",
    "plan_handle": "o_custkey",
    "creation_time": "o_orderdate",
    "last_execution_time": "o_orderdate",
    "execution_count": "o_custkey + 1",
    "max_worker_time": "CAST(round(o_totalprice * 100) AS BIGINT)",
    "total_worker_time": "CAST(round(o_totalprice * 100) AS BIGINT) * 3",
    "max_grant_kb": "o_custkey * 2",
    "max_used_grant_kb": "o_custkey",
    "total_spills": "o_custkey % 9",
    "statement_start_offset": "4",
    "statement_end_offset": "CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 90 END",
}


@query(
    "top_cpu_missing_index",
    f"""WITH s AS (SELECT {sql_columns(STATS)} FROM orders),
    h AS (SELECT DISTINCT o_custkey, o_orderpriority, o_orderkey FROM orders
          JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
    SELECT sql_handle, CASE WHEN statement_end_offset = -1 THEN substring(text, 3)
        ELSE substring(text, 3, 44) END AS query_text,
      c_name AS query_plan, creation_time, last_execution_time, execution_count, max_worker_time,
      total_worker_time // execution_count AS avg_worker_time, max_grant_kb, max_used_grant_kb,
      total_spills
    FROM s JOIN h ON query_hash = o_custkey AND query_plan_hash = o_orderpriority
        AND sql_handle = o_orderkey
      JOIN documents ON sql_handle = doc_id JOIN customer ON plan_handle = c_custkey
    ORDER BY max_worker_time DESC, sql_handle LIMIT 50""",
)
def top_cpu_missing_index(spark, sf):
    orders = load(spark, sf, "orders")
    hints = (
        load(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("query_hash"),
            F.col("o_orderpriority").alias("query_plan_hash"),
            F.col("l_orderkey").alias("last_sql_handle"),
        )
    )
    texts = load(spark, sf, "documents").select(F.col("doc_id").alias("sql_handle"), "text")
    plans = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("plan_handle"), F.col("c_name").alias("query_plan")
    )
    return workload.top_cpu_missing_index(derive(orders, STATS), texts, plans, hints)


@query(
    "statement_text",
    """SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (
      SELECT doc_id, CASE WHEN lang = 'en' THEN substring(text, n_chars // 4 + 1)
        ELSE substring(text, n_chars // 4 + 1, n_chars // 2 - n_chars // 4 + 1) END AS s
      FROM documents)""",
)
def statements(spark, sf):
    docs = load(spark, sf, "documents")
    start = F.call_function("div", F.col("n_chars"), F.lit(4)) * 2
    end = F.when(F.col("lang") == "en", -1).otherwise(
        F.call_function("div", F.col("n_chars"), F.lit(2)) * 2
    )
    return docs.select("doc_id", statement_text("text", start, end).alias("s")).select(
        "doc_id", F.length("s").alias("n"), F.md5("s").alias("digest")
    )


@query(
    "querystore_top_cpu",
    f"""WITH q AS (
      SELECT l_orderkey AS plan_id, l_shipdate AS last_execution_time, o_orderdate AS first_execution_time,
        CAST(l_quantity AS BIGINT) AS count_executions, {sql_cents('l_extendedprice')} AS avg_cpu_time,
        l_tax AS avg_duration, o_orderpriority AS query_plan_hash, c_custkey AS query_hash,
        CASE WHEN c_acctbal < 0 THEN 'No Parent Object' ELSE c_name END AS parent_object_name,
        n_name AS query_sql_text, o_orderstatus AS query_plan
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
      WHERE l_shipdate >= TIMESTAMP '1995-01-08' - INTERVAL 7 DAY AND o_orderstatus <> 'P'
        AND c_mktsegment <> 'MACHINERY' AND {sql_cents('l_extendedprice')} >= 10000
      ORDER BY avg_cpu_time DESC, last_execution_time DESC, plan_id, count_executions LIMIT 100)
    SELECT * FROM q WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = query_hash
      AND o.o_orderpriority = query_plan_hash AND o.o_orderstatus = 'P')""",
)
def querystore_top_cpu(spark, sf):
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    runtime = load(spark, sf, "lineitem").join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey"
    ).select(
        F.col("l_orderkey").alias("plan_id"),
        F.col("l_shipdate").alias("last_execution_time"),
        F.col("o_orderdate").alias("first_execution_time"),
        F.col("l_quantity").cast("bigint").alias("count_executions"),
        cents("l_extendedprice").alias("avg_cpu_time"),
        F.col("l_tax").alias("avg_duration"),
    )
    plan = orders.select(
        F.col("o_orderkey").alias("plan_id"),
        F.col("o_custkey").alias("query_id"),
        F.col("o_orderstatus").alias("query_plan"),
        F.col("o_orderpriority").alias("query_plan_hash"),
        (F.col("o_orderstatus") == "P").alias("is_online_index_plan"),
    )
    queries = customer.select(
        F.col("c_custkey").alias("query_id"),
        F.col("c_nationkey").alias("query_text_id"),
        F.col("c_custkey").alias("query_hash"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("object_name"),
        (F.col("c_mktsegment") == "MACHINERY").alias("is_internal_query"),
    )
    texts = load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("query_text_id"), F.col("n_name").alias("query_sql_text")
    )
    hints = orders.filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("query_hash"),
        F.col("o_orderpriority").alias("query_plan_hash"),
        F.col("o_orderdate").alias("last_user_seek"),
        F.col("o_orderdate").alias("last_user_scan"),
    )
    return workload.querystore_top_cpu(
        runtime, plan, queries, texts, hints, instant("1995-01-08 00:00:00")
    )


@query(
    "tuning_recommendations",
    f"""SELECT event_type AS reason, CAST(user_id AS INTEGER) AS score,
      'EXEC force ' || CAST(event_id AS VARCHAR) || ' "x"' AS script,
      CAST(event_id AS INTEGER) AS query_id, CAST(user_id AS INTEGER) AS new_plan_id,
      CAST(user_id + 1 AS INTEGER) AS recommended_plan_id,
      (CAST(user_id AS INTEGER) + 7) * (CAST({sql_cents('value')} AS DOUBLE) - 1000) / 1000000
        AS estimated_gain
    FROM events WHERE event_type <> 'view'""",
)
def tuning_recommendations(spark, sf):
    details = F.to_json(
        F.struct(
            F.struct(
                F.concat(F.lit("EXEC force "), F.col("event_id").cast("string"), F.lit(' "x"'))
                .alias("script"),
                F.lit("TSql").alias("method"),
            ).alias("implementationDetails"),
            F.when(
                F.col("event_type") != "view",
                F.struct(
                    F.col("event_id").alias("queryId"),
                    F.col("user_id").alias("regressedPlanId"),
                    F.lit(0).alias("regressedPlanErrorCount"),
                    F.col("user_id").alias("regressedPlanExecutionCount"),
                    cents("value").cast("double").alias("regressedPlanCpuTimeAverage"),
                    (F.col("user_id") + 1).alias("recommendedPlanId"),
                    F.lit(7).alias("recommendedPlanExecutionCount"),
                    F.lit(1000.0).alias("recommendedPlanCpuTimeAverage"),
                ),
            ).alias("planForceDetails"),
        )
    )
    recommendations = load(spark, sf, "events").select(
        F.col("event_type").alias("reason"),
        F.col("user_id").cast("int").alias("score"),
        details.alias("details"),
    )
    return workload.tuning_recommendations(recommendations)


REQUESTS = {
    "session_id": "event_id",
    "command": "CASE event_type WHEN 'click' THEN 'BACKUP DATABASE' WHEN 'view' THEN 'RESTORE LOG' "
    "WHEN 'error' THEN 'RESTORE HEADERONLY' ELSE 'SELECT' END",
    "start_time": "ts",
    "percent_complete": "value",
    "estimated_completion_time": "CAST(round(value * 100) AS BIGINT) * 1234",
    "sql_handle": "user_id",
}


def _sql_hms(s: str) -> str:
    return (
        f"CAST({s} // 3600 AS VARCHAR) || ' hour(s), ' || CAST({s} % 3600 // 60 AS VARCHAR) || 'min, ' "
        f"|| CAST({s} % 60 AS VARCHAR) || ' sec'"
    )


@query(
    "running_requests",
    f"""WITH r AS (SELECT {sql_columns(REQUESTS)} FROM events),
    s AS (SELECT *, date_diff('second', date_trunc('second', start_time), TIMESTAMP '2024-02-01') AS e,
      estimated_completion_time // 1000 AS g FROM r WHERE command <> 'SELECT')
    SELECT session_id, command, c_name AS text, start_time, percent_complete, {_sql_hms('e')} AS running_time,
      {_sql_hms('g')} AS est_time_to_go,
      TIMESTAMP '2024-02-01' + to_seconds(g) AS est_completion_time
    FROM s JOIN customer ON sql_handle = c_custkey""",
)
def running_requests(spark, sf):
    texts = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("sql_handle"), F.col("c_name").alias("text")
    )
    return workload.running_requests(
        derive(load(spark, sf, "events"), REQUESTS), texts, instant("2024-02-01 00:00:00")
    )


SEEDING = {
    "local_database_name": "concat('DB', CAST(o_orderkey AS STRING))",
    "remote_machine_name": "o_orderpriority",
    "role_desc": "CASE o_orderstatus WHEN 'F' THEN 'Source' ELSE 'Destination' END",
    "transfer_rate_bytes_per_second": "CAST(round(o_totalprice * 100) AS BIGINT)",
    "transferred_size_bytes": "CASE WHEN o_orderstatus = 'F' THEN "
    "CAST(round(o_totalprice * 100) AS BIGINT) * 1000 ELSE o_custkey * 1048576 END",
    "database_size_bytes": "CAST(round(o_totalprice * 100) AS BIGINT) * 1000",
    "start_time_utc": "o_orderdate",
    "estimate_time_complete_utc": "o_orderdate",
    "total_disk_io_wait_time_ms": "o_custkey",
    "total_network_wait_time_ms": "o_orderkey",
    "is_compression_enabled": "o_orderstatus = 'O'",
}


@query(
    "seeding_progress",
    f"""WITH s AS (SELECT {sql_columns(SEEDING)} FROM orders)
    SELECT local_database_name, remote_machine_name, role_desc AS role,
      transfer_rate_bytes_per_second // 1024 // 1024 AS mb_per_second,
      transferred_size_bytes // 1024 // 1024 AS transferred_size_mb,
      database_size_bytes // 1024 // 1024 AS database_size_mb,
      {sql_ratio('transferred_size_bytes', 'database_size_bytes', 7, 2, 100)} AS percent_done,
      start_time_utc + INTERVAL 2 HOUR AS start_time,
      estimate_time_complete_utc + INTERVAL 2 HOUR AS estimate_time_complete,
      total_disk_io_wait_time_ms, total_network_wait_time_ms, is_compression_enabled
    FROM s""",
)
def seeding_progress(spark, sf):
    return workload.seeding_progress(derive(load(spark, sf, "orders"), SEEDING), tz="+02:00")



"""Counters: events per user and type as cumulative counters, line items per supplier as file I/O."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import counters
from fleetlens.operators.counters import RATE_COUNTER, RAW_COUNTER
from fleetlens.plans import file_latency_series
from proxies.base import cents, instant, load, query, sql_cents, sql_ratio

FIRST, SECOND = "2024-01-08 00:00:00", "2024-02-01 00:00:00"
COUNTERS = ["waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms"]
INTERVAL_START = "1998-01-01 00:00:00"


def event_counters(spark, sf: str) -> DataFrame:
    """Counters of every event, before aggregation."""
    value = cents("value")
    return load(spark, sf, "events").select(
        "user_id", "event_type", "ts", value.alias("c"), F.expr("1L").alias("one"),
        F.call_function("div", value, F.lit(4)).alias("g"),
    )


def event_snapshot(spark, sf: str, before: str) -> DataFrame:
    """Cumulative counters of all events before an instant."""
    return (
        event_counters(spark, sf)
        .filter(F.col("ts") < instant(before))
        .groupBy("user_id", "event_type")
        .agg(
            F.count("*").alias("waiting_tasks_count"),
            F.sum("c").alias("wait_time_ms"),
            F.sum("g").alias("signal_wait_time_ms"),
        )
    )


def landed_snapshots(spark, sf: str) -> DataFrame:
    """Both snapshots as one landed table, from a single scan of the events."""
    instants = F.array(instant(FIRST), instant(SECOND))
    return (
        event_counters(spark, sf)
        .withColumn("snapshot_ts", F.explode(F.filter(instants, lambda t: F.col("ts") < t)))
        .groupBy("user_id", "event_type", "snapshot_ts")
        .agg(
            F.count("*").alias("waiting_tasks_count"),
            F.sum("c").alias("wait_time_ms"),
            F.sum("g").alias("signal_wait_time_ms"),
        )
    )


def sql_snapshot(name: str, before: str) -> str:
    return f"""{name} AS (
      SELECT user_id, event_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS w,
             CAST(sum(c // 4) AS BIGINT) AS g
      FROM (SELECT *, {sql_cents('value')} AS c FROM events)
      WHERE ts < TIMESTAMP '{before}' GROUP BY user_id, event_type)"""


SQL_SNAPSHOTS = f"WITH {sql_snapshot('b', FIRST)}, {sql_snapshot('a', SECOND)}"

_DELTA_SQL = f"""{SQL_SNAPSHOTS}
SELECT user_id, event_type, a.n - b.n AS waiting_tasks_count, a.w - b.w AS wait_time_ms,
       a.g - b.g AS signal_wait_time_ms
FROM a JOIN b USING (user_id, event_type)"""


@query("snapshot_delta", _DELTA_SQL)
def snapshot_delta(spark, sf):
    return counters.snapshot_delta(
        event_snapshot(spark, sf, FIRST),
        event_snapshot(spark, sf, SECOND),
        ["user_id", "event_type"],
        COUNTERS,
    )


@query("snapshot_pair_delta", _DELTA_SQL)
def snapshot_pair_delta(spark, sf):
    on = ["user_id", "event_type"]
    pair = counters.snapshot_pair(
        landed_snapshots(spark, sf), on, "snapshot_ts", instant(FIRST), instant(SECOND), COUNTERS
    )
    return counters.pair_delta(pair, on, COUNTERS)


@query(
    "successive_delta",
    f"""WITH e AS (SELECT user_id, event_type, ts, {sql_cents('value')} AS c, event_id FROM events),
    l AS (SELECT *, lag(ts) OVER w AS previous_ts, c - lag(c) OVER w AS dc,
                 event_id - lag(event_id) OVER w AS di
          FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts))
    SELECT user_id, event_type, previous_ts, ts, CASE WHEN dc >= 0 AND di >= 0 THEN dc END AS c,
           CASE WHEN dc >= 0 AND di >= 0 THEN di END AS event_id, (dc < 0 OR di < 0) AS reset
    FROM l WHERE previous_ts IS NOT NULL""",
)
def successive_delta(spark, sf):
    rows = load(spark, sf, "events").withColumn("c", cents("value"))
    return counters.successive_delta(rows, ["user_id", "event_type"], "ts", ["c", "event_id"])


def gappy_cents():
    """Values of which every fifth event was not read."""
    return F.when(F.col("event_id") % 5 != 0, cents("value"))


@query(
    "successive_delta_gaps",
    f"""WITH e AS (SELECT user_id, event_type, ts, event_id,
           CASE WHEN event_id % 5 <> 0 THEN {sql_cents('value')} END AS c FROM events),
    l AS (SELECT *, lag(ts) OVER p AS previous_ts, c - last_value(c IGNORE NULLS) OVER w AS dc,
                 event_id - last_value(event_id IGNORE NULLS) OVER w AS di
          FROM e WINDOW p AS (PARTITION BY user_id, event_type ORDER BY ts),
            w AS (PARTITION BY user_id, event_type ORDER BY ts
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT *, (coalesce(dc, 0) < 0 OR coalesce(di, 0) < 0) AS reset FROM l)
    SELECT user_id, event_type, previous_ts, ts, CASE WHEN NOT reset THEN dc END AS c,
           CASE WHEN NOT reset THEN di END AS event_id, reset
    FROM r WHERE previous_ts IS NOT NULL""",
)
def successive_delta_gaps(spark, sf):
    rows = load(spark, sf, "events").withColumn("c", gappy_cents())
    return counters.successive_delta(rows, ["user_id", "event_type"], "ts", ["c", "event_id"])


# --- file I/O: one file per supplier, in the database of its nation -------------------------------

def io_pair(spark, sf: str) -> DataFrame:
    """I/O counters of every file before an instant and now, from one scan of the line items."""
    lines = load(spark, sf, "lineitem").select(
        "l_suppkey",
        (F.col("l_returnflag") == "R").alias("is_read"),
        (F.col("l_shipdate") < instant(INTERVAL_START)).alias("is_before"),
        cents("l_extendedprice").alias("bytes"),
        F.col("l_quantity").cast("bigint").alias("stall"),
        F.expr("1L").alias("one"),
    )

    def total(column: str, read: bool, before: bool):
        hit = F.col("is_read") == read
        if before:
            hit = hit & F.col("is_before")
        return F.coalesce(F.sum(F.when(hit, F.col(column))), F.lit(0))

    sources = {
        "num_of_reads": ("one", True),
        "num_of_bytes_read": ("bytes", True),
        "io_stall_read_ms": ("stall", True),
        "num_of_writes": ("one", False),
        "num_of_bytes_written": ("bytes", False),
        "io_stall_write_ms": ("stall", False),
    }
    sums = lines.groupBy("l_suppkey").agg(
        *[total(c, r, True).alias(f"before_{n}") for n, (c, r) in sources.items()],
        *[total(c, r, False).alias(f"after_{n}") for n, (c, r) in sources.items()],
    )
    owners = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("database_id")
    )
    return sums.join(owners, "l_suppkey").withColumnRenamed("l_suppkey", "file_id").withColumns(
        {"has_before": F.lit(True), "has_after": F.lit(True)}
    )


def io_stats(spark, sf: str) -> DataFrame:
    """Cumulative I/O counters of every file."""
    pair = io_pair(spark, sf)
    return pair.select(
        "database_id",
        "file_id",
        *[F.col(f"after_{c}").alias(c) for c in counters.IO_COUNTER_COLUMNS],
        (F.col("after_io_stall_read_ms") + F.col("after_io_stall_write_ms")).alias("io_stall"),
        F.lit(60000).alias("sample_ms"),
        (F.col("after_num_of_bytes_written") * 16).alias("size_on_disk_bytes"),
        F.encode(F.col("file_id").cast("string"), "UTF-8").alias("file_handle"),
    )


def io_files(spark, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("database_id"),
        F.col("s_suppkey").alias("file_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("D:\\data\\"), "s_name").alias("physical_name"),
        F.when(F.col("s_acctbal") < 0, "LOG").otherwise("ROWS").alias("type_desc"),
    )


def io_databases(spark, sf: str) -> DataFrame:
    return load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("database_id"), F.col("n_name").alias("name")
    )


def _sql_io(condition: str = "TRUE") -> str:
    def total(value: str, read: bool) -> str:
        flag = "=" if read else "<>"
        return (
            f"CAST(coalesce(sum({value}) FILTER (WHERE l_returnflag {flag} 'R' AND {condition}), 0)"
            " AS BIGINT)"
        )

    price, quantity = sql_cents("l_extendedprice"), "CAST(l_quantity AS BIGINT)"
    return f"""SELECT s_nationkey AS database_id, l_suppkey AS file_id, s_name AS file_name,
        'D:\\data\\' || s_name AS path, CASE WHEN s_acctbal < 0 THEN 'LOG' ELSE 'ROWS' END AS kind,
        n_name AS database_name,
        {total('1', True)} AS r, {total(price, True)} AS rb, {total(quantity, True)} AS rs,
        {total('1', False)} AS w, {total(price, False)} AS wb, {total(quantity, False)} AS ws
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      GROUP BY ALL"""


_AFTER = f"l_shipdate >= TIMESTAMP '{INTERVAL_START}'"


@query(
    "io_latency_interval",
    f"""WITH io AS ({_sql_io(_AFTER)})
    SELECT database_id, file_id, database_name, file_name, path AS file_path, kind AS file_type,
      r AS reads, {sql_ratio('rb', '1048576', 12, 3)} AS read_mb,
      {sql_ratio('wb', '1048576', 12, 3)} AS written_mb, w AS writes, r + w AS io_count,
      {sql_ratio('rb', 'rb + wb', 5, 2, 100)} AS read_pct,
      {sql_ratio('wb', 'rb + wb', 5, 2, 100)} AS write_pct,
      rs AS read_stall, ws AS write_stall,
      coalesce({sql_ratio('rs', 'r', 12, 3)}, 0) AS avg_read_stall,
      coalesce({sql_ratio('ws', 'w', 12, 3)}, 0) AS avg_write_stall
    FROM io WHERE rb + wb > 20 * 1048576""",
)
def io_latency_interval(spark, sf):
    delta = counters.pair_delta(
        io_pair(spark, sf), ["database_id", "file_id"], counters.IO_COUNTER_COLUMNS
    )
    return counters.io_latency_interval(
        delta, io_files(spark, sf), io_databases(spark, sf), min_bytes=20 * 1048576
    )


def monthly_io(spark, sf: str) -> DataFrame:
    """I/O snapshots: each line item is one snapshot row of its supplier's counters.

    The price and quantity of a line stand for the counter values, so counters do go down.
    """
    files = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("database_id")
    )
    months = (
        load(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"))
        .agg(
            F.count("*").alias("num_of_reads"),
            F.sum(cents("l_extendedprice")).alias("num_of_bytes_read"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("io_stall_read_ms"),
        )
    )
    same = {
        "num_of_writes": "num_of_reads",
        "num_of_bytes_written": "num_of_bytes_read",
        "io_stall_write_ms": "io_stall_read_ms",
    }
    return months.join(files, "l_suppkey").withColumnRenamed("l_suppkey", "file_id").withColumns(
        {n: F.col(c) for n, c in same.items()}
    )


@query(
    "file_latency_series",
    f"""WITH m AS (
      SELECT l_suppkey, s_nationkey, s_name, s_acctbal, n_name, date_trunc('month', l_shipdate) AS ts,
        count(*) AS r, CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) AS b,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      GROUP BY ALL),
    d AS (SELECT *, lag(ts) OVER w AS p, r - lag(r) OVER w AS dr, b - lag(b) OVER w AS db,
            s - lag(s) OVER w AS ds
          FROM m WINDOW w AS (PARTITION BY l_suppkey ORDER BY ts))
    SELECT CAST(p AS TIMESTAMP) AS previous_ts, CAST(ts AS TIMESTAMP) AS ts,
      s_nationkey AS database_id, l_suppkey AS file_id,
      n_name AS database_name, s_name AS file_name, 'D:\\data\\' || s_name AS file_path,
      CASE WHEN s_acctbal < 0 THEN 'LOG' ELSE 'ROWS' END AS file_type, dr AS reads,
      {sql_ratio('db', '1048576', 12, 3)} AS read_mb, {sql_ratio('db', '1048576', 12, 3)} AS written_mb,
      dr AS writes, dr + dr AS io_count, CAST(50 AS DOUBLE) AS read_pct, CAST(50 AS DOUBLE) AS write_pct,
      ds AS read_stall, ds AS write_stall,
      coalesce({sql_ratio('ds', 'dr', 12, 3)}, 0) AS avg_read_stall,
      coalesce({sql_ratio('ds', 'dr', 12, 3)}, 0) AS avg_write_stall
    FROM d WHERE p IS NOT NULL AND dr >= 0 AND db >= 0 AND ds >= 0 AND db + db > 0""",
)
def file_latency_intervals(spark, sf):
    return file_latency_series(
        monthly_io(spark, sf), io_files(spark, sf), io_databases(spark, sf), keys=(), min_bytes=0,
        ts="ts", slice_unit="year",
    )


@query(
    "io_latency_cumulative",
    f"""WITH io AS ({_sql_io()})
    SELECT database_name, file_name, kind AS file_type, r AS num_reads, w AS num_writes,
      rb AS read_bytes, wb AS write_bytes, rb * 100 // nullif(rb + wb, 0) AS percent_bytes_read,
      wb * 100 // nullif(rb + wb, 0) AS percent_bytes_write,
      coalesce(rs // nullif(r, 0), 0) AS avg_read_latency_ms,
      coalesce(rb // nullif(r, 0), 0) // 1024 AS avg_read_size_kb,
      coalesce(ws // nullif(w, 0), 0) AS avg_write_latency_ms,
      coalesce(wb // nullif(w, 0), 0) // 1024 AS avg_write_size_kb,
      coalesce((rs + ws) // nullif(r + w, 0), 0) AS avg_latency_ms,
      coalesce((rb + wb) // nullif(r + w, 0), 0) // 1024 AS avg_io_size_kb,
      path AS physical_name
    FROM io""",
)
def io_latency_cumulative(spark, sf):
    return counters.io_latency_cumulative(
        io_stats(spark, sf), io_files(spark, sf), io_databases(spark, sf)
    )


@query(
    "io_latency_capture",
    f"""WITH io AS ({_sql_io()})
    SELECT CAST((SELECT max(year(o_orderdate)) FROM orders) + 1 AS INTEGER) AS capture_id,
      TIMESTAMP '2024-02-01 00:00:00' AS capture_date,
      coalesce(rs // nullif(r, 0), 0) AS read_latency, coalesce(ws // nullif(w, 0), 0) AS write_latency,
      coalesce((rs + ws) // nullif(r + w, 0), 0) AS latency,
      coalesce(rb // nullif(r, 0), 0) AS avg_b_per_read,
      coalesce(wb // nullif(w, 0), 0) AS avg_b_per_write,
      coalesce((rb + wb) // nullif(r + w, 0), 0) AS avg_b_per_transfer,
      'D:' AS drive, database_name AS db, database_id, file_id, 60000 AS sample_ms,
      r AS num_of_reads, rb AS num_of_bytes_read, rs AS io_stall_read_ms, w AS num_of_writes,
      wb AS num_of_bytes_written, ws AS io_stall_write_ms, rs + ws AS io_stall,
      {sql_ratio('wb * 16 // 1024', '1024', 25, 6)} AS size_on_disk_mb, path AS physical_name
    FROM io""",
)
def io_latency_capture(spark, sf):
    history = load(spark, sf, "orders").select(F.year("o_orderdate").alias("capture_id"))
    return counters.io_latency_capture(
        io_stats(spark, sf),
        io_files(spark, sf),
        io_databases(spark, sf),
        history,
        instant("2024-02-01 00:00:00"),
    ).drop("file_handle")


@query(
    "perf_counter_rates",
    f"""{SQL_SNAPSHOTS}
    SELECT 'Events' AS object_name, event_type AS counter_name,
      CAST(user_id AS VARCHAR) AS instance_name,
      CASE event_type WHEN 'click' THEN (a.n - b.n) * 1000 * 1000000 // 2073600000
                      WHEN 'view' THEN (a.n - b.n) * 1000 * 1000000 // 2073600000
                      WHEN 'error' THEN a.n * 1000000 END AS cntr_value
    FROM a JOIN b USING (user_id, event_type) WHERE event_type IN ('click', 'view', 'error', 'signup')""",
)
def perf_counter_rates(spark, sf):
    kind = (
        F.when(F.col("event_type").isin("click", "view"), RATE_COUNTER)
        .when(F.col("event_type") == "error", RAW_COUNTER)
        .otherwise(0)
    )

    def snapshot(before: str) -> DataFrame:
        return event_snapshot(spark, sf, before).select(
            instant(before).alias("collected_time"),
            F.lit("Events").alias("object_name"),
            F.col("event_type").alias("counter_name"),
            F.col("user_id").cast("string").alias("instance_name"),
            (F.col("waiting_tasks_count") * 1000000).alias("cntr_value"),
            kind.alias("cntr_type"),
        )

    wanted = [("Events", e) for e in ("click", "view", "error", "signup")]
    return counters.perf_counter_rates(snapshot(FIRST), snapshot(SECOND), wanted)


@query(
    "page_compression_success",
    f"""WITH o AS (SELECT l_partkey, l_linenumber, count(*) AS n,
        count(*) FILTER (WHERE l_returnflag = 'R') AS ok, sum(l_quantity) AS q
      FROM lineitem GROUP BY ALL)
    SELECT DISTINCT p_name AS table_name, p_brand || ' ' || p_type AS index_name,
      l_linenumber AS partition_number, n AS page_compression_attempt_count,
      ok AS page_compression_success_count, {sql_ratio('ok', 'n', 12, 6)} AS success_rate
    FROM o JOIN part ON l_partkey = p_partkey WHERE q >= 60""",
)
def page_compression_success(spark, sf):
    part = load(spark, sf, "part")
    lines = (
        load(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("object_id"), F.col("l_linenumber").alias("partition_number"))
        .agg(
            F.count("*").alias("page_compression_attempt_count"),
            F.count_if(F.col("l_returnflag") == "R").alias("page_compression_success_count"),
            F.sum("l_quantity").alias("q"),
        )
    )
    sizes = part.select(F.col("p_partkey").alias("object_id"), F.col("p_size").alias("index_id"))
    indexes = part.select(
        F.col("p_partkey").alias("object_id"),
        F.col("p_size").alias("index_id"),
        F.col("p_name").alias("table_name"),
        F.concat_ws(" ", "p_brand", "p_type").alias("name"),
    )
    partitions = lines.select(
        "object_id", "partition_number", F.when(F.col("q") >= 60, 2).otherwise(0).alias("data_compression")
    )
    return counters.page_compression_success(lines.join(sizes, "object_id"), indexes, partitions)

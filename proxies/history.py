"""Orders as a command log and as backup history."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import history
from proxies.base import derive, instant, load, query, sql_cents, sql_columns

LOG = {
    "id": "o_orderkey",
    "database_name": "concat('DB', CAST(o_custkey AS STRING))",
    "command_type": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'DBCC_CHECKDB' ELSE 'ALTER_INDEX' END",
    "start_time": "o_orderdate",
    "error_number": "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN "
    "CASE WHEN o_custkey % 2 = 0 THEN 1205 ELSE 2627 END END",
    "seconds": "CAST(round(o_totalprice) AS BIGINT)",
}


def command_log(spark, sf: str):
    log = derive(load(spark, sf, "orders"), LOG)
    end = F.when(
        F.col("id") % 7 != 0, F.col("start_time") + F.make_dt_interval(secs=F.col("seconds"))
    )
    return log.withColumn("end_time", end)


@query(
    "command_outcome",
    f"""WITH l AS (SELECT {sql_columns(LOG)} FROM orders)
    SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN error_number IS NULL THEN 'Not Executed'
        WHEN error_number = 0 THEN 'Succeeded' ELSE 'Failed' END AS outcome,
      CASE WHEN id % 7 <> 0 THEN
        CASE WHEN seconds // 86400 > 0 THEN CAST(seconds // 86400 AS VARCHAR) || '.' ELSE '' END
        || strftime(TIMESTAMP '1900-01-01' + to_seconds(seconds % 86400), '%H:%M:%S') END AS duration
    FROM l""",
)
def command_outcome(spark, sf):
    return history.command_outcome(command_log(spark, sf)).select("id", "outcome", "duration")


@query(
    "last_success",
    f"""WITH l AS (SELECT {sql_columns(LOG)} FROM orders)
    SELECT database_name, max(start_time) AS max_start_time FROM l
    WHERE command_type = 'DBCC_CHECKDB' AND error_number = 0 GROUP BY database_name""",
)
def last_success(spark, sf):
    return history.last_success(command_log(spark, sf))


@query(
    "severity_policy",
    f"""WITH l AS (SELECT {sql_columns(LOG)} FROM orders)
    SELECT id, CASE error_number WHEN 1205 THEN 10 WHEN 2627 THEN 16 END AS severity,
      CASE error_number WHEN 2627 THEN 2627 ELSE 0 END AS return_code FROM l""",
)
def severity_policy(spark, sf):
    return history.severity_policy(command_log(spark, sf), 10).select("id", "severity", "return_code")


ASOF = "1999-01-01 00:00:00"


@query(
    "purge_older_than",
    f"""SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate >= TIMESTAMP '{ASOF}' - INTERVAL 30 DAY""",
)
def purge_older_than(spark, sf):
    return history.purge_older_than(
        load(spark, sf, "orders"), "o_orderdate", instant(ASOF)
    ).select("o_orderkey", "o_orderdate")


@query(
    "purge_impact",
    f"""WITH t AS (SELECT {sql_cents('o_totalprice')} AS c,
        o_orderdate >= TIMESTAMP '{ASOF}' - INTERVAL 120 DAY AS kept
      FROM orders WHERE o_orderstatus <> 'P')
    SELECT count(*) AS rows_before, count(*) FILTER (WHERE kept) AS rows_after,
      CAST(sum(c) AS BIGINT) AS size_before, CAST(sum(c) FILTER (WHERE kept) AS BIGINT) AS size_after,
      count(*) FILTER (WHERE NOT kept) AS diff_rows,
      CAST(sum(c) FILTER (WHERE NOT kept) AS BIGINT) AS diff_size FROM t""",
)
def purge_impact(spark, sf):
    orders = load(spark, sf, "orders")
    kept = history.purge_older_than(
        orders, "o_orderdate", instant(ASOF), history.BACKUP_HISTORY_DAYS
    )

    def table_sizes(rows):
        name = F.when(F.col("o_orderstatus") == "O", "backupset").when(
            F.col("o_orderstatus") == "F", "BackupFile"
        ).otherwise("sysjobhistory")
        return rows.groupBy(F.col("o_orderpriority").alias("server"), name.alias("table_name")).agg(
            F.count("*").alias("row_count"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("data_space_used"),
        )

    return history.purge_impact(table_sizes(orders), table_sizes(kept))

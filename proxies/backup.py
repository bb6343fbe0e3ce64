"""Backup planning: customers as databases, orders as backup history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import backup
from fleetlens.operators.selection import as_rules
from fleetlens.plans import backup_plan, integrity_check_plan
from proxies.base import derive, instant, load, query, sql_columns

ASOF = "2001-08-05 09:07:03.004005"

DATABASES = {
    "database_name": "CASE WHEN c_custkey = 0 THEN 'master' ELSE c_name END",
    "server": "c_nationkey",
    "state_desc": "CASE WHEN c_custkey % 20 = 3 THEN 'OFFLINE' WHEN c_custkey % 20 = 4 THEN 'EMERGENCY' "
    "ELSE 'ONLINE' END",
    "user_access_desc": "CASE WHEN c_custkey % 9 = 1 THEN 'SINGLE_USER' ELSE 'MULTI_USER' END",
    "is_accessible": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 6 <> 1 END",
    "is_in_standby": "c_custkey % 31 = 5",
    "is_read_only": "c_custkey % 7 = 2",
    "recovery_model": "CASE c_custkey % 3 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'FULL' ELSE 'BULK_LOGGED' END",
    "availability_group": "CASE WHEN c_custkey % 5 < 3 THEN concat('AG', CAST(c_nationkey AS STRING)) END",
    "role": "CASE c_custkey % 4 WHEN 0 THEN 'PRIMARY' WHEN 1 THEN 'SECONDARY' WHEN 2 THEN 'PRIMARY' END",
    "is_preferred_replica": "CASE c_custkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END",
    "log_shipping_role": "CASE WHEN c_custkey % 11 = 6 THEN 'PRIMARY' WHEN c_custkey % 11 = 7 THEN 'SECONDARY' END",
    "differential_base_lsn": "CASE WHEN c_custkey % 8 <> 7 THEN c_custkey * 10 END",
    "last_log_backup_lsn": "CASE WHEN c_custkey % 10 <> 9 THEN c_custkey * 10 + 5 END",
    "allocated_extent_page_count": "CASE WHEN c_custkey % 13 <> 12 THEN CAST(abs(round(c_acctbal * 100)) AS BIGINT) END",
    "modified_extent_page_count": "CASE WHEN c_custkey % 14 <> 12 THEN CAST(abs(round(c_acctbal * 7)) AS BIGINT) "
    "* (c_custkey % 4) END",
    "database_size": "CAST(abs(round(c_acctbal * 100)) AS BIGINT) + 100",
    "log_since_last_log_backup_mb": "CASE WHEN c_custkey % 15 <> 14 THEN c_custkey * 2.5e0 END",
    "log_backup_time": "CASE WHEN c_custkey % 16 <> 15 THEN TIMESTAMP_NTZ '2001-08-05 09:00:00' END",
    "selected": "TRUE",
    "start_position": "c_nationkey",
}
_SQL_DATABASES = sql_columns(DATABASES).replace("TIMESTAMP_NTZ", "TIMESTAMP")

BACKUPS = {
    "database_name": "CASE WHEN o_custkey = 0 THEN 'master' ELSE "
    "concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')) END",
    "type": "CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'L' ELSE 'I' END",
    "backup_start_date": "o_orderdate",
    "last_lsn": "CASE WHEN o_orderpriority < '3' THEN o_custkey * 10 - 1 ELSE o_custkey * 10 + 1 END",
    "checkpoint_lsn": "CASE WHEN o_orderpriority < '4' THEN o_custkey * 10 ELSE o_custkey * 10 + 3 END",
    "is_damaged": "o_totalprice < 100000",
    "is_snapshot": "o_totalprice > 450000",
}


def databases(spark, sf: str) -> DataFrame:
    return derive(load(spark, sf, "customer"), DATABASES)


def backups(spark, sf: str) -> DataFrame:
    return derive(load(spark, sf, "orders"), BACKUPS)


def _sql_typed(requested: str) -> str:
    return f"""d AS (SELECT {_SQL_DATABASES} FROM customer),
    h AS (SELECT {sql_columns(BACKUPS)} FROM orders),
    s AS (SELECT d.*, (SELECT bool_or(is_snapshot) FROM h WHERE h.type = 'D'
        AND h.database_name = d.database_name AND h.checkpoint_lsn = d.differential_base_lsn)
        AS base_is_snapshot FROM d),
    f AS (SELECT *, CASE WHEN '{requested}' = 'LOG' AND recovery_model <> 'SIMPLE'
        AND last_log_backup_lsn IS NULL AND database_name <> 'master' THEN 'DIFF' ELSE '{requested}' END AS first
      FROM s),
    t AS (SELECT * EXCLUDE (first), CASE WHEN first = 'DIFF' AND (database_name = 'master'
        OR differential_base_lsn IS NULL OR coalesce(base_is_snapshot, FALSE)
        OR coalesce(allocated_extent_page_count > 0
          AND modified_extent_page_count * 100 >= allocated_extent_page_count * 15, FALSE))
        THEN 'FULL' ELSE first END AS backup_type FROM f)"""


def typed(spark, sf: str, requested: str) -> DataFrame:
    based = backup.differential_base_snapshot(databases(spark, sf), backups(spark, sf))
    return backup.backup_type(based, requested, change=True, modification_level=15)


for _kind in ("LOG", "DIFF"):

    @query(
        f"backup_type_{_kind.lower()}",
        f"WITH {_sql_typed(_kind)} SELECT database_name, base_is_snapshot, backup_type FROM t",
    )
    def _typed(spark, sf, kind=_kind):
        return typed(spark, sf, kind).select("database_name", "base_is_snapshot", "backup_type")


_ON_PRIMARY = "(availability_group IS NULL OR coalesce(role = 'PRIMARY', FALSE))"
_ON_PREFERRED = "(availability_group IS NULL OR coalesce(is_preferred_replica, FALSE))"
_SQL_OPEN = """state_desc = 'ONLINE' AND NOT is_in_standby
    AND (is_accessible OR user_access_desc <> 'SINGLE_USER')"""
_SQL_HAS_BASE = "differential_base_lsn IS NOT NULL AND database_name <> 'master'"
_SQL_HAS_CHAIN = """recovery_model IN ('FULL', 'BULK_LOGGED') AND last_log_backup_lsn IS NOT NULL
      AND database_name <> 'master'"""
_SQL_ELIGIBLE = f"""{_SQL_OPEN} AND CASE backup_type WHEN 'FULL' THEN {_ON_PRIMARY}
    WHEN 'DIFF' THEN {_SQL_HAS_BASE} AND {_ON_PRIMARY}
    WHEN 'LOG' THEN {_SQL_HAS_CHAIN} AND {_ON_PREFERRED} ELSE FALSE END"""


@query(
    "backup_eligible",
    f"""WITH {_sql_typed('LOG')}
    SELECT database_name, coalesce({_SQL_ELIGIBLE} AND NOT is_read_only
      AND (backup_type <> 'LOG' OR (coalesce(log_shipping_role, '') <> 'PRIMARY'
        AND (coalesce(log_since_last_log_backup_mb >= 1000, TRUE)
          OR coalesce(date_diff('second', log_backup_time, TIMESTAMP '2001-08-05 09:07:03') >= 600, TRUE)))),
      FALSE) AS eligible
    FROM t""",
)
def backup_eligible(spark, sf):
    return backup.backup_eligible(
        typed(spark, sf, "LOG"), instant(ASOF), updateability="READ_WRITE", exclude_log_shipped=True,
        min_log_size_mb=1000, min_log_age_s=600,
    ).select("database_name", "eligible")


@query(
    "backup_eligible_copy_only",
    f"""WITH {_sql_typed('DIFF')}
    SELECT database_name, coalesce({_SQL_OPEN} AND CASE backup_type WHEN 'FULL' THEN {_ON_PREFERRED}
      WHEN 'DIFF' THEN {_SQL_HAS_BASE} AND {_ON_PRIMARY} END, FALSE) AS eligible
    FROM t""",
)
def backup_eligible_copy_only(spark, sf):
    return backup.backup_eligible(
        typed(spark, sf, "DIFF"), instant(ASOF), copy_only=True
    ).select("database_name", "eligible")


_SQL_SIZE = """CASE backup_type
      WHEN 'FULL' THEN coalesce(allocated_extent_page_count, database_size) * 8192
      WHEN 'DIFF' THEN modified_extent_page_count * 8192
      ELSE CAST(trunc(log_since_last_log_backup_mb * 1024 * 1024) AS BIGINT) END"""


@query(
    "backup_file_count",
    f"""WITH {_sql_typed('LOG')}, z AS (SELECT database_name, {_SQL_SIZE} AS backup_size FROM t)
    SELECT database_name, backup_size, CAST(CASE WHEN backup_size IS NULL OR backup_size = 0 THEN 3
      ELSE 3 * least(backup_size // 3 // (100 * 1048576)
        + CASE WHEN (backup_size // 3) % (100 * 1048576) = 0 THEN 0 ELSE 1 END, 64 // 3) END AS INTEGER)
      AS number_of_files FROM z""",
)
def backup_file_count(spark, sf):
    return backup.backup_file_count(
        typed(spark, sf, "LOG"), 3, max_file_size_mb=100
    ).select("database_name", "backup_size", "number_of_files")


@query(
    "backup_file_count_by_minimum",
    f"""WITH {_sql_typed('DIFF')}, z AS (SELECT database_name, {_SQL_SIZE} AS backup_size FROM t)
    SELECT database_name, backup_size,
      CASE WHEN backup_size IS NULL OR backup_size >= 1000 * 1048576 THEN 8 ELSE 4 END AS number_of_files
    FROM z""",
)
def backup_file_count_by_minimum(spark, sf):
    return backup.backup_file_count(
        typed(spark, sf, "DIFF"), 4, n_files=8, min_size_for_multiple_mb=1000
    ).select("database_name", "backup_size", "number_of_files")


@query(
    "stripe_files",
    """WITH n AS (SELECT o_orderkey, 3 * (1 + o_custkey % 7) AS n FROM orders),
    k AS (SELECT o_orderkey, n, unnest(range(1, n + 1)) AS k FROM n)
    SELECT o_orderkey, CAST(n AS INTEGER) AS number_of_files, CAST(k AS INTEGER) AS file_number,
      CASE WHEN k <= n // 3 THEN 1 WHEN k <= 2 * n // 3 THEN 2 ELSE 3 END AS directory_number,
      CASE WHEN k <= n // 3 THEN 'D:/a' WHEN k <= 2 * n // 3 THEN 'E:/b' ELSE 'F:/c' END AS directory_path
    FROM k""",
)
def stripe_files(spark, sf):
    plan = load(spark, sf, "orders").select(
        "o_orderkey", (3 * (1 + F.col("o_custkey") % 7)).cast("int").alias("number_of_files")
    )
    return backup.stripe_files(plan, ["D:/a", "E:/b", "F:/c"])


@query(
    "render_template",
    f"""WITH d AS (SELECT {_SQL_DATABASES}, c_mktsegment FROM customer)
    SELECT database_name, CASE WHEN availability_group IS NULL
        THEN CAST(server AS VARCHAR) || '\\' || database_name || '\\LOG'
        ELSE CAST(server AS VARCHAR) || '$' || availability_group || '\\' || database_name || '\\LOG' END
        || CASE WHEN is_read_only THEN '_PARTIAL' ELSE '' END AS folder,
      'W' || CAST(CAST(strftime(TIMESTAMP '2001-08-05', '%U') AS INTEGER) + 1 AS VARCHAR) || '_' || CASE WHEN is_read_only THEN 'PARTIAL_' ELSE '' END || database_name
        || '_20010805_090703004_004005'
        || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '_1' END || '.trn' AS file
    FROM d""",
)
def render_template(spark, sf):
    rows = derive(load(spark, sf, "customer"), {**DATABASES, "segment": "c_mktsegment"})
    tokens = {
        "ServerName": F.col("server").cast("string"),
        "InstanceName": F.col("availability_group"),
        "DatabaseName": F.col("database_name"),
        "BackupType": F.lit("LOG"),
        "Partial": F.when(F.col("is_read_only"), "PARTIAL"),
        "CopyOnly": F.lit(None).cast("string"),
        "FileNumber": F.when(F.col("segment") != "BUILDING", "1"),
        "NumberOfFiles": F.lit(None).cast("string"),
        "FileExtension": F.lit("trn"),
    }
    foldered = backup.render_template(
        rows, backup.DIRECTORY_STRUCTURE, tokens, instant(ASOF), "folder", directory=True
    )
    template = (
        "{CopyOnly}_W{Week}-${CopyOnly}_{Partial}_{DatabaseName}_{Year}{Month}{Day}_"
        "{Hour}{Minute}{Second}{Millisecond}_{Microsecond}_{FileNumber}of{NumberOfFiles}.{FileExtension}"
    )
    return backup.render_template(foldered, template.replace("-$", "_"), tokens, instant(ASOF), "file").select(
        "database_name", "folder", "file"
    )


_SQL_CLEANUP = """(SELECT max(backup_start_date) FROM h WHERE NOT h.is_damaged
      AND h.database_name = t.database_name
      AND (h.type IN ('D', 'I') OR (h.type = 'L' AND h.last_lsn < t.differential_base_lsn)))"""


@query(
    "cleanup_cutoff",
    f"""WITH {_sql_typed('LOG')}, l AS (SELECT *, {_SQL_CLEANUP} AS latest_backup FROM t)
    SELECT database_name, latest_backup, CASE WHEN backup_type = 'LOG' THEN
        CASE WHEN latest_backup IS NOT NULL THEN least(latest_backup, TIMESTAMP '2001-06-06 09:07:03.004005') END
      ELSE TIMESTAMP '2001-06-06 09:07:03.004005' END AS cleanup_date FROM l""",
)
def cleanup_cutoff(spark, sf):
    return backup.cleanup_cutoff(
        typed(spark, sf, "LOG"), backups(spark, sf), 60 * 24, instant(ASOF)
    ).select("database_name", "latest_backup", "cleanup_date")


@query(
    "check_eligible",
    f"""WITH d AS (SELECT {_SQL_DATABASES} FROM customer)
    SELECT database_name, coalesce(state_desc IN ('ONLINE', 'EMERGENCY')
      AND NOT (user_access_desc = 'SINGLE_USER' AND NOT is_accessible)
      AND (role IS NULL OR (role = 'PRIMARY' AND is_preferred_replica)) AND is_read_only, FALSE) AS eligible
    FROM d""",
)
def check_eligible(spark, sf):
    return backup.check_eligible(
        databases(spark, sf), "PREFERRED_BACKUP_REPLICA", "READ_ONLY", edition=2
    ).select("database_name", "eligible")


@query(
    "backup_plan",
    f"""WITH {_sql_typed('FULL')},
    o AS (SELECT *, row_number() OVER (ORDER BY database_size DESC, database_name) AS item_order FROM t
      WHERE database_name ILIKE 'customer%' AND database_name NOT ILIKE '%9'),
    e AS (SELECT *, {_SQL_SIZE} AS backup_size FROM o
      WHERE {_SQL_ELIGIBLE.replace('backup_type', "'FULL'")}),
    n AS (SELECT *, CAST(CASE WHEN backup_size = 0 THEN 2 ELSE 2 * least(backup_size // 2 // (512 * 1048576)
        + CASE WHEN backup_size // 2 % (512 * 1048576) = 0 THEN 0 ELSE 1 END, 32) END AS INTEGER)
        AS number_of_files FROM e),
    k AS (SELECT *, unnest(range(1, number_of_files + 1)) AS k FROM n)
    SELECT database_name, item_order, backup_type, number_of_files, CAST(k AS INTEGER) AS file_number,
      TIMESTAMP '2001-08-03 09:07:03.004005' AS cleanup_date,
      CASE WHEN k <= number_of_files // 2 THEN '/x' ELSE '/y' END || '/' || database_name || '/FULL/'
        || database_name || '_FULL_20010805_090703_'
        || CASE WHEN number_of_files >= 10 THEN lpad(CAST(k AS VARCHAR), 2, '0') ELSE CAST(k AS VARCHAR) END
        || '.bak' AS file_path
    FROM k""",
)
def backup_plans(spark, sf):
    plan = backup_plan(
        databases(spark, sf).drop("selected", "start_position"), backups(spark, sf), instant(ASOF),
        rules=as_rules(spark, "customer%, -%9"), mode="DATABASE_SIZE_DESC",
        directories=["/x", "/y"], cleanup_hours=48, file_options={"max_file_size_mb": 512},
    )
    return plan.select(
        "database_name", "item_order", "backup_type", "number_of_files", "file_number", "cleanup_date",
        "file_path",
    )


@query(
    "integrity_check_plan",
    f"""WITH d AS (SELECT {_SQL_DATABASES} FROM customer),
    l AS (SELECT o_custkey, max(o_orderdate) AS last_good_check FROM orders
      WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' GROUP BY o_custkey),
    j AS (SELECT d.*, last_good_check FROM d LEFT JOIN l ON d.database_name =
      'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')),
    o AS (SELECT *, row_number() OVER (ORDER BY last_good_check NULLS FIRST, database_name) AS item_order FROM j)
    SELECT database_name, last_good_check, item_order FROM o
    WHERE coalesce(state_desc IN ('ONLINE', 'EMERGENCY')
      AND NOT (user_access_desc = 'SINGLE_USER' AND NOT is_accessible), FALSE)""",
)
def integrity_checks(spark, sf):
    checks = (
        load(spark, sf, "orders")
        .filter("o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'")
        .groupBy("o_custkey")
        .agg(F.max("o_orderdate").alias("last_good_check"))
        .select(
            F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
            .alias("database_name"),
            "last_good_check",
        )
    )
    dbs = databases(spark, sf).drop("selected", "start_position").join(checks, "database_name", "left")
    return integrity_check_plan(dbs).select("database_name", "last_good_check", "item_order")

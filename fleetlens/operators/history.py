"""Command log and history retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import seconds_between
from fleetlens.functions.text import duration_text

# Deadlock victim and lock timeout errors; severities.
LOCK_ERRORS = [1205, 1222]
DEFAULT_SEVERITY = 16
INFORMATIONAL_SEVERITY = 10

# Days of history kept for logs and for backup history.
LOG_DAYS = 30
BACKUP_HISTORY_DAYS = 120


def command_outcome(log: DataFrame) -> DataFrame:
    """Outcome and duration text of logged commands.

    A finished row without an error number was not executed; a row without an end time is still
    running and has neither.
    """
    outcome = (
        F.when(F.col("end_time").isNull(), F.lit(None).cast("string"))
        .when(F.col("error_number").isNull(), "Not Executed")
        .when(F.col("error_number") == 0, "Succeeded")
        .otherwise("Failed")
    )
    return log.withColumns(
        {
            "outcome": outcome,
            "duration": duration_text(seconds_between("start_time", "end_time")),
        }
    )


def last_success(
    log: DataFrame, command_type: str = "DBCC_CHECKDB", keys: Sequence[str] = ()
) -> DataFrame:
    """Start of the last successful command of a type, per database."""
    return (
        log.filter((F.col("command_type") == command_type) & (F.col("error_number") == 0))
        .groupBy(*keys, "database_name")
        .agg(F.max("start_time").alias("max_start_time"))
    )


def severity_policy(log: DataFrame, lock_severity: int = DEFAULT_SEVERITY) -> DataFrame:
    """Severity of logged errors; lock errors take ``lock_severity``.

    ``return_code`` is the error number, except that lock errors are ignored at severity 10.
    """
    number = F.col("error_number")
    lock = number.isin(*LOCK_ERRORS)
    failed = number != 0
    ignored = lock & F.lit(lock_severity == INFORMATIONAL_SEVERITY)
    return log.withColumns(
        {
            "severity": F.when(failed, F.when(lock, lock_severity).otherwise(DEFAULT_SEVERITY)),
            "return_code": F.when(failed & ~ignored, number).otherwise(0),
        }
    )


def purge_older_than(
    df: DataFrame, ts: str, asof: Column, days: int = LOG_DAYS
) -> DataFrame:
    """Rows that survive a retention of ``days`` days.

    Filtered on the raw column, so partition pruning and row-group skipping apply.  Write the result
    with :func:`fleetlens.sources.sinks.replace_version`.
    """
    return df.filter(F.col(ts) >= asof - F.make_dt_interval(F.lit(days)))


def purge_impact(before: DataFrame, after: DataFrame, prefix: str = "backup") -> DataFrame:
    """Rows and size of the history tables of all servers before and after a purge."""
    tagged = before.withColumn("_before", F.lit(True)).unionByName(
        after.withColumn("_before", F.lit(False))
    ).filter(F.lower("table_name").startswith(prefix.lower()))

    def total(column: str, is_before: bool) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_before") == is_before, F.col(column))), F.lit(0))

    sums = tagged.agg(
        total("row_count", True).alias("rows_before"),
        total("row_count", False).alias("rows_after"),
        total("data_space_used", True).alias("size_before"),
        total("data_space_used", False).alias("size_after"),
    )
    return sums.withColumns(
        {
            "diff_rows": F.col("rows_before") - F.col("rows_after"),
            "diff_size": F.col("size_before") - F.col("size_after"),
        }
    )

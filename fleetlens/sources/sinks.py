"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_capture(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append a capture to its history."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def save_snapshot(df: DataFrame, table: str) -> None:
    """Create a table from a query result, replacing an earlier one."""
    df.write.mode("overwrite").saveAsTable(table)


def write_statements(df: DataFrame, column: str, path: str, order: Sequence[str] = ()) -> None:
    """Statements as text files, one per line, appended.

    With ``order`` the rows are range partitioned, so the files read in name order are in order.
    """
    lines = df.filter(F.col(column).isNotNull())
    if order:
        lines = lines.orderBy(*order)
    lines.select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode(
        "append"
    ).text(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def replace_version(df: DataFrame, root: str) -> str:
    """Write the next version of a table that ``df`` may itself read; returns its path.

    Versions are folders ``v<number>-<id>`` under ``root``; readers take the greatest complete one
    (:func:`latest_version`).
    """
    versions = _complete_versions(df.sparkSession, root)
    number = versions[-1][0] + 1 if versions else 1
    path = f"{root}/v{number:08d}-{uuid4().hex[:8]}"
    df.write.parquet(path)
    return path


def latest_version(spark: SparkSession, root: str) -> str | None:
    """Path of the newest complete version under ``root``."""
    versions = _complete_versions(spark, root)
    return versions[-1][1] if versions else None


def _complete_versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    marker = hadoop.Path(f"{root}/v*/_SUCCESS")
    found = marker.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marker) or []
    folders = [status.getPath().getParent() for status in found]
    return sorted((int(f.getName()[1:9]), f.toString()) for f in folders)

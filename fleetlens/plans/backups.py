"""Backup and integrity-check plans of a whole fleet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import concat_text, file_system_name
from fleetlens.operators.backup import (
    DIRECTORY_STRUCTURE,
    FILE_NAME,
    backup_eligible,
    backup_file_count,
    backup_type,
    cap_database_name,
    check_eligible,
    cleanup_cutoff,
    differential_base_snapshot,
    file_number_text,
    render_template,
    stripe_files,
)
from fleetlens.operators.selection import order_items, select_items

EXTENSIONS = {"FULL": "bak", "DIFF": "bak", "LOG": "trn"}


def _chosen(dbs: DataFrame, rules: DataFrame | None, mode: str | None, keys: Sequence[str],
            bounded: bool) -> DataFrame:
    picked = select_items(dbs, rules, ["database_name"]).withColumn("name", F.col("database_name"))
    return order_items(picked, mode, keys, bounded).drop("name")


def backup_plan(
    dbs: DataFrame,
    backups: DataFrame,
    asof: Column,
    requested: str = "FULL",
    rules: DataFrame | None = None,
    mode: str | None = None,
    keys: Sequence[str] = (),
    directories: Sequence[str] = ("/backup",),
    separator: str = "/",
    change: bool = False,
    modification_level: int | None = None,
    cleanup_hours: int | None = None,
    tokens: Mapping[str, Column] | None = None,
    eligibility: Mapping | None = None,
    file_options: Mapping | None = None,
    extensions: Mapping[str, str] = EXTENSIONS,
    bounded: bool = False,
) -> DataFrame:
    """One row per backup file to write, in work order.

    Selection and order, type, eligibility, number and place of the files, their names, and the
    date up to which older files may be deleted.
    """
    chosen = _chosen(dbs, rules, mode, keys, bounded)
    typed = backup_type(
        differential_base_snapshot(chosen, backups, keys), requested, change, modification_level
    )
    ready = backup_eligible(typed, asof, **dict(eligibility or {})).filter("eligible")
    counted = backup_file_count(ready, len(directories), **dict(file_options or {}))
    dated = cleanup_cutoff(counted, backups, cleanup_hours, asof, keys)
    named = dated.withColumn("_fs_name", file_system_name("database_name"))
    extension = F.lit(None).cast("string")
    for kind, text in extensions.items():
        extension = F.when(F.col("backup_type") == kind, text).otherwise(extension)
    none = F.lit(None).cast("string")
    values = {
        "ServerName": F.col("server") if "server" in keys else none,
        "InstanceName": none,
        "ServiceName": none,
        "ClusterName": none,
        "AvailabilityGroupName": F.col("availability_group"),
        "BackupType": F.col("backup_type"),
        "Partial": none,
        "CopyOnly": none,
        "Description": none,
        **dict(tokens or {}),
    }
    foldered = render_template(
        named, DIRECTORY_STRUCTURE, {**values, "DatabaseName": F.col("_fs_name")}, asof, "_folder",
        directory=True, separator=separator,
    )
    single = F.col("number_of_files") == 1
    keep = F.when(~single, F.lit("{FileNumber}"))
    filed = render_template(
        foldered,
        FILE_NAME,
        {
            **values,
            "DatabaseName": F.lit("{DatabaseName}"),
            "FileNumber": keep,
            "NumberOfFiles": F.when(~single, F.col("number_of_files").cast("string")),
            "FileExtension": extension,
        },
        asof,
        "_file",
    )
    longest = max(len(d) for d in directories) + 2 * len(separator)
    capped = filed.withColumn(
        "_file",
        cap_database_name(
            F.col("_file"), F.length("_folder") + longest, F.col("_fs_name"),
            F.col("number_of_files"),
        ),
    )
    striped = stripe_files(capped, directories)
    number = file_number_text(F.col("file_number"), F.col("number_of_files"))
    path = concat_text(
        F.col("directory_path"), separator, F.col("_folder"), separator,
        F.replace(F.col("_file"), F.lit("{FileNumber}"), number),
    )
    return striped.withColumn("file_path", path).drop("_folder", "_file", "_fs_name", "selected")


def integrity_check_plan(
    dbs: DataFrame,
    rules: DataFrame | None = None,
    mode: str | None = "DATABASE_LAST_GOOD_CHECK_ASC",
    keys: Sequence[str] = (),
    replicas: str = "ALL",
    updateability: str = "ALL",
    edition: int = 3,
    bounded: bool = False,
) -> DataFrame:
    """Databases to check, in work order (longest unchecked first by default)."""
    chosen = _chosen(dbs, rules, mode, keys, bounded)
    return check_eligible(chosen, replicas, updateability, edition).filter("eligible").drop(
        "selected", "eligible"
    )

"""Space, growth, cache and compression reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import int_div, pages_to_mb, pages_to_mb_exact, ratio
from fleetlens.functions.text import concat_text, quote_name

# System databases left out of the free-space report.
SYSTEM_DATABASES = ["distribution", "master", "model", "msdb"]

# The trace events that record a file growing, and file type names by code.
GROW_EVENTS = ["Data File Auto Grow", "Log File Auto Grow"]
FILE_TYPES = {0: "Row", 1: "Log", 2: "FILESTREAM", 4: "Full-text"}

# Id of the hidden resource database, of the system schema, of the last system object.
RESOURCE_DATABASE_ID = 32767
SYSTEM_SCHEMA_ID = 4
LAST_SYSTEM_OBJECT_ID = 100


def file_free_space(
    files: DataFrame,
    keys: Sequence[str] = (),
    system: Sequence[str] = tuple(SYSTEM_DATABASES),
    ordered: bool = True,
) -> DataFrame:
    """Size and free space of data and log files, most free space first.

    Input sizes are 8 KiB pages: ``size`` and ``space_used``.
    """
    out = files.filter(F.col("type").isin(0, 1) & ~F.col("db_name").isin(*system)).select(
        *keys,
        "db_name",
        "file_name",
        "type_desc",
        pages_to_mb_exact("size").alias("current_size_mb"),
        pages_to_mb_exact("(size - space_used)").alias("free_space_mb"),
        "physical_name",
    )
    if not ordered:
        return out
    return out.orderBy(F.desc("free_space_mb"), *keys, "db_name", "file_name")


def autogrowth_violations(
    files: DataFrame, filegroups: DataFrame, keys: Sequence[str] = (), server: Column | None = None
) -> DataFrame:
    """Files that grow by a percentage or by an odd number of megabytes, with a remediation text.

    ``server`` is the instance name shown in the message (default: the ``server`` key or empty).
    """
    if server is None:
        server = F.col("server") if "server" in keys else F.lit("")
    groups = filegroups.select(
        *keys,
        "database_name",
        F.col("data_space_id").alias("fg_space_id"),
        F.col("name").alias("_group"),
        F.col("type_desc").alias("_group_type"),
    )
    joined = files.withColumn("fg_space_id", F.col("data_space_id")).join(
        groups.withColumn("_found", F.lit(True)), [*keys, "database_name", "fg_space_id"], "left"
    )
    is_log = F.col("data_space_id") == 0
    growth_mb = int_div("growth", 128)
    return (
        joined.withColumn("growth_mb", growth_mb)
        .filter((F.col("growth_mb") % 2 != 0) | F.col("is_percent_growth"))
        .select(
            *keys,
            "database_name",
            "file_id",
            F.col("name").alias("logical_name"),
            "physical_name",
            "type_desc",
            "state_desc",
            "is_percent_growth",
            "growth",
            "growth_mb",
            int_div("size", 128).alias("total_size_mb"),
            "max_size",
            F.when(is_log, "Log").otherwise(F.col("_group")).alias("filegroup_name"),
            F.when(is_log, "Log").otherwise(F.col("_group_type")).alias("filegroup_type"),
            F.col("data_space_id").alias("f_space_id"),
            F.when(F.col("_found"), F.col("fg_space_id")).alias("fg_space_id"),
            concat_text(
                "ALTER DATABASE [",
                F.col("database_name"),
                "] MODIFY FILE ( NAME = N'",
                F.col("name"),
                "', SIZE = 65536KB , FILEGROWTH = 65536KB )",
            ).alias("remediation"),
            concat_text(
                "- Database file autogrowth settings on database ",
                F.col("database_name"),
                " - instance ",
                server,
            ).alias("message"),
        )
    )


def autogrow_history(
    trace: DataFrame,
    events: DataFrame,
    files: DataFrame,
    keys: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """File growth events with the growth settings of the file, newest first."""
    wanted = events.filter(F.col("name").isin(*GROW_EVENTS)).select(
        F.col("trace_event_id").alias("event_class"), F.col("name").alias("event_name")
    )
    settings = files.select(
        *keys,
        "database_id",
        F.col("name").alias("file_name"),
        "physical_name",
        "type",
        "growth",
        "is_percent_growth",
        "size",
        "max_size",
    )
    file_type = F.lit(None).cast("string")
    for code, label in FILE_TYPES.items():
        file_type = F.when(F.col("type") == code, label).otherwise(file_type)
    setting = F.when(
        F.col("is_percent_growth"), concat_text(F.col("growth").cast("string"), "%")
    ).otherwise(concat_text(pages_to_mb_exact("growth", 19, 2).cast("string"), "MB"))
    limit = F.when(F.col("max_size") == -1, "Unlimited").otherwise(
        pages_to_mb_exact("max_size", 19, 2).cast("string")
    )
    out = (
        trace.join(wanted, "event_class")
        .join(settings, [*keys, "database_id", "file_name"])
        .select(
            *keys,
            "database_name",
            F.col("physical_name").alias("db_file_name"),
            file_type.alias("file_type"),
            "event_name",
            pages_to_mb_exact("integer_data", 19, 2).alias("auto_grow_size_mb"),
            "start_time",
            ratio("duration", 1_000_000, 19, 2).alias("event_duration_s"),
            setting.alias("auto_grow_setting"),
            pages_to_mb_exact("size", 19, 2).alias("file_size_mb"),
            limit.alias("max_file_size"),
        )
    )
    return out.orderBy(F.desc("start_time")) if ordered else out


def _page_counts() -> list[Column]:
    dirty = F.when(F.col("is_modified"), 1).otherwise(0)
    return [
        F.sum(dirty).alias("dirty_page_count"),
        F.sum(F.lit(1) - dirty).alias("clean_page_count"),
    ]


_PAGE_SIZES = {
    "dirty_page_mb": "dirty_page_count",
    "clean_page_mb": "clean_page_count",
}


def buffer_pool_by_db(
    pages: DataFrame, dbs: DataFrame, keys: Sequence[str] = (), ordered: bool = True
) -> DataFrame:
    """Dirty and clean cached pages per database."""
    counts = pages.groupBy(*keys, "database_id").agg(*_page_counts())
    names = dbs.select(*keys, "database_id", "name")
    label = F.when(F.col("database_id") == RESOURCE_DATABASE_ID, "Resource Database").otherwise(
        F.col("name")
    )
    out = counts.join(names, [*keys, "database_id"], "left").select(
        *keys,
        label.alias("database_name"),
        "dirty_page_count",
        "clean_page_count",
        *[pages_to_mb(c).alias(n) for n, c in _PAGE_SIZES.items()],
    )
    return out.orderBy(*keys, "database_name") if ordered else out


def buffer_pool_by_object(
    pages: DataFrame,
    allocation_units: DataFrame,
    partitions: DataFrame,
    indexes: DataFrame,
    objects: DataFrame,
    keys: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Dirty and clean cached pages per index and allocation unit.

    The pages are reduced to one row per allocation unit before the joins.  The catalog tables hold
    the databases to report; put ``database_id`` into ``keys`` for more than one.
    """
    counts = pages.groupBy(*keys, "allocation_unit_id").agg(*_page_counts())
    units = allocation_units.select(
        *keys,
        "allocation_unit_id",
        F.col("container_id").alias("partition_id"),
        F.col("type_desc").alias("allocation_type"),
    )
    parts = partitions.filter(F.col("object_id") > LAST_SYSTEM_OBJECT_ID).select(
        *keys, "partition_id", "object_id", "index_id"
    )
    named = indexes.select(
        *keys,
        "object_id",
        "index_id",
        F.col("name").alias("index_name"),
        F.col("type_desc").alias("index_type"),
    )
    owners = objects.select(*keys, "object_id", F.col("name").alias("object_name"))
    out = (
        counts.join(units, [*keys, "allocation_unit_id"])
        .join(parts, [*keys, "partition_id"])
        .join(named, [*keys, "object_id", "index_id"])
        .join(owners, [*keys, "object_id"], "left")
        .select(
            *keys,
            "object_name",
            "index_id",
            "index_name",
            "index_type",
            "allocation_type",
            "dirty_page_count",
            "clean_page_count",
            *[pages_to_mb(c).alias(n) for n, c in _PAGE_SIZES.items()],
        )
    )
    return out.orderBy(*keys, "object_name", "index_id") if ordered else out


def log_space(usage: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Transaction log size and use."""
    total, used = F.col("total_log_size_in_bytes"), F.col("used_log_space_in_bytes")
    return usage.select(
        *keys,
        int_div(total, 1048576).alias("total_log_size_mb"),
        int_div(total - used, 1048576).alias("free_space_mb"),
        ratio("used_log_space_in_bytes", 1048576, 20, 8).alias("used_log_space_mb"),
        "used_log_space_in_percent",
    )


def large_index_inventory(
    objects: DataFrame,
    indexes: DataFrame,
    partitions: DataFrame,
    partition_stats: DataFrame,
    schemas: DataFrame,
    min_mb: int = 2000,
    keys: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Indexes using more than ``min_mb`` megabytes outside the system schema, most rows first."""
    used_mb = pages_to_mb("used_page_count")
    big = partition_stats.filter(used_mb > min_mb).select(
        *keys,
        "partition_id",
        "row_count",
        used_mb.alias("size_used_mb"),
        pages_to_mb("reserved_page_count").alias("size_reserved_mb"),
    )
    parts = partitions.select(
        *keys, "partition_id", "object_id", "index_id", "data_compression_desc"
    )
    owners = objects.filter(F.col("schema_id") != SYSTEM_SCHEMA_ID).select(
        *keys, "object_id", "schema_id", F.col("name").alias("table_name")
    )
    named = indexes.select(
        *keys, "object_id", "index_id", F.col("name").alias("index_name"), "type_desc"
    )
    spaces = schemas.select(*keys, "schema_id", F.col("name").alias("schema_name"))
    out = (
        big.join(parts, [*keys, "partition_id"])
        .join(owners, [*keys, "object_id"])
        .join(named, [*keys, "object_id", "index_id"])
        .join(spaces, [*keys, "schema_id"], "left")
        .select(
            *keys,
            "schema_name",
            "table_name",
            "index_name",
            "index_id",
            "type_desc",
            "row_count",
            "size_used_mb",
            "size_reserved_mb",
            "data_compression_desc",
        )
    )
    return out.orderBy(F.desc("row_count"), *keys, "table_name", "index_id") if ordered else out


def compression_savings(
    inventory: DataFrame,
    estimates: DataFrame,
    indexes: DataFrame,
    keys: Sequence[str] = (),
    min_compressed_kb: int = 102400,
    min_saving_pct: int = 5,
    min_saving_mb: int = 2000,
    ordered: bool = True,
) -> DataFrame:
    """Indexes worth compressing, with the saving extrapolated from the sampled sizes.

    Column store indexes are left out.  The saving percentage is ``DECIMAL(7, 2)``, wide enough for
    a compression that enlarges the index.
    """
    compressed_kb = F.col("size_with_requested_kb")
    saving_mb = int_div(F.col("size_used_mb") * 1024 - compressed_kb, 1024)
    sample = "sample_size_with_current_kb"
    saving_pct = ratio(f"({sample} - sample_size_with_requested_kb)", sample, 7, 2, factor=100)
    eligible = indexes.filter("type_desc <> 'CLUSTERED COLUMNSTORE'").select(
        *keys, "table_name", "index_id", F.col("name").alias("_catalog_name")
    )
    table = concat_text(quote_name("schema_name"), ".", quote_name("table_name"))
    command = F.when(
        F.col("index_name").isNull(),
        concat_text("ALTER TABLE ", table, " REBUILD WITH ( DATA_COMPRESSION = PAGE)"),
    ).otherwise(
        concat_text(
            "ALTER INDEX ",
            quote_name("index_name"),
            " ON  ",
            table,
            " REBUILD WITH ( DATA_COMPRESSION = PAGE)",
        )
    )
    measured = estimates.filter(compressed_kb > min_compressed_kb).filter(
        saving_pct > min_saving_pct
    ).select(
        *keys,
        "schema_name",
        F.col("object_name").alias("table_name"),
        "index_id",
        "partition_number",
        "size_with_requested_kb",
        saving_pct.alias("compression_saving_pct"),
    )
    out = (
        inventory.join(measured, [*keys, "schema_name", "table_name", "index_id"])
        .filter(saving_mb > min_saving_mb)
        .join(eligible, [*keys, "table_name", "index_id"])
        .select(
            *keys,
            table.alias("table_name"),
            F.when(F.col("index_id") > 0, quote_name("_catalog_name")).alias("index_name"),
            "type_desc",
            "row_count",
            "size_used_mb",
            int_div(compressed_kb, 1024).alias("estimated_compressed_size_mb"),
            saving_mb.alias("estimated_saving_mb"),
            "compression_saving_pct",
            command.alias("command"),
        )
    )
    return out.orderBy(F.desc("estimated_saving_mb"), *keys, "table_name") if ordered else out


def _plan_size_mb() -> Column:
    return int_div(int_div(F.sum(F.col("size_in_bytes").cast("bigint")), 1024), 1024)


def plan_cache_single_use(plans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ad-hoc plans used once: the bloat of the plan cache."""
    once = plans.filter("objtype = 'Adhoc' and usecounts = 1")
    return once.groupBy(*keys, "objtype", "cacheobjtype").agg(
        int_div(F.sum(F.col("usecounts").cast("bigint")), F.count("usecounts")).alias(
            "avg_use_count"
        ),
        F.sum(F.col("refcounts").cast("bigint")).alias("single_use_cached_plans"),
        _plan_size_mb().alias("size_mb"),
    )


def plan_cache_summary(
    plans: DataFrame, keys: Sequence[str] = (), ordered: bool = True
) -> DataFrame:
    """Plans, references and size per kind of cached object, most plans first."""
    out = plans.groupBy(*keys, "objtype", "cacheobjtype").agg(
        F.count("*").alias("count_plans"),
        F.sum(F.col("refcounts").cast("bigint")).alias("sum_refcounts"),
        _plan_size_mb().alias("size_mb"),
    )
    if not ordered:
        return out
    return out.orderBy(F.desc("count_plans"), *keys, "objtype", "cacheobjtype")

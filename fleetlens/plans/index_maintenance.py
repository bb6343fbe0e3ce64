"""Index and statistics maintenance plan of a whole fleet, as one set-based pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.distributed import BROADCAST_ROWS, stored
from fleetlens.operators.maintenance import (
    DEFAULT_PREFERENCES,
    FRAGMENTATION_LEVEL_1,
    FRAGMENTATION_LEVEL_2,
    MIN_NUMBER_OF_PAGES,
    allowed_actions,
    choose_action,
    extended_info,
    fragmentation,
    index_command,
    index_stat_targets,
    order_targets,
    partition_level_statistics,
    statistics_command,
    stats_update_decision,
)
from fleetlens.operators.selection import select_items

SELECTION_COLUMNS = ["database_name", "schema_name", "object_name", "target_name"]


def _asked_partitions(stats_properties: DataFrame, targets: DataFrame) -> DataFrame:
    """Counters of partitions, without the partition numbers that no target has.

    Statistics may have many more partitions than targets ask for, and are told apart here without a
    shuffle of them.  The numbers are few: those of the index with the most partitions.
    """
    rows = stats_properties.filter("partition_number is not null")
    numbers = targets.filter("partition_number is not null").select("partition_number").distinct()
    if numbers.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return rows
    return rows.join(F.broadcast(numbers), "partition_number", "left_semi")


def _with_partition_counters(planned: DataFrame, counters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incremental statistics are judged by the counters of the partition itself, where known.

    A statistic has a bounded number of partitions, so their counters travel as a list, by the keys
    that the rows are already partitioned by.
    """
    known = counters.groupBy(*keys, "object_id", F.col("stats_id").alias("statistics_id")).agg(
        F.collect_list(F.struct(
            F.col("partition_number").alias("_number"), F.col("rows").alias("_rows"),
            F.col("modification_counter").alias("_modified"),
        )).alias("_counters")
    )
    joined = planned.join(known, [*keys, "object_id", "statistics_id"], "left")
    here = F.filter("_counters", lambda c: c["_number"] == F.col("partition_number"))
    own = F.col("is_incremental") & F.col("_rows").isNotNull()
    return (
        joined.select(*planned.columns, F.inline_outer(here))
        .withColumns({
            "row_count": F.when(own, F.col("_rows")).otherwise(F.col("row_count")),
            "modification_counter": F.when(own, F.col("_modified")).otherwise(F.col("modification_counter")),
        })
        .drop("_number", "_rows", "_modified")
    )


def index_maintenance_plan(
    catalog: Mapping[str, DataFrame],
    physical_stats: DataFrame,
    stats_properties: DataFrame,
    keys: Sequence[str] = (),
    rules: DataFrame | None = None,
    preferences: Mapping[str, Sequence[str]] = DEFAULT_PREFERENCES,
    l1: float = FRAGMENTATION_LEVEL_1,
    l2: float = FRAGMENTATION_LEVEL_2,
    min_pages: int = MIN_NUMBER_OF_PAGES,
    max_pages: int | None = None,
    update_statistics: str | None = None,
    only_modified: bool = False,
    modification_level: int | None = None,
    partition_level: bool = True,
    version: float = 15.0,
    edition: int = 3,
    index_options: Mapping | None = None,
    statistics_options: Mapping | None = None,
) -> DataFrame:
    """Targets in work order with their action, commands and notes.

    ``keys`` identify a database and include ``database_name`` when ``rules`` (an ``indexes`` list,
    see :func:`~fleetlens.operators.selection.parse_rules`) are given.
    """
    k = list(keys)
    incremental = partition_level_statistics(version, edition, partition_level)
    targets = index_stat_targets(
        catalog, k, any(preferences.values()), update_statistics, partition_level, incremental
        and "incremental_stats" in catalog,
    ).withColumn("target_name", F.coalesce("index_name", "statistics_name"))
    chosen = select_items(
        targets, None if rules is None else rules.withColumnRenamed("index_name", "target_name"),
        SELECTION_COLUMNS,
    )
    idx = [*k, "object_id", "index_id"]
    on_part = ["partition_number"] if partition_level else []
    measured = fragmentation(physical_stats, k, partition_level)
    whole = stats_properties.filter("partition_number is null").select(
        *k, "object_id", F.col("stats_id").alias("statistics_id"),
        F.col("rows").alias("row_count"), "modification_counter",
    )
    # The order reads its rows several times; the joins that find the targets run once.
    kept = stored(chosen.filter("selected"), "targets")
    of_statistic = [*k, "object_id", "statistics_id"]
    planned = order_targets(kept, k).join(measured, [*idx, *on_part], "left").join(whole, of_statistic, "left")
    if incremental:
        planned = _with_partition_counters(planned, _asked_partitions(stats_properties, kept), k)
    acted = choose_action(
        allowed_actions(planned, version, edition), preferences, min_pages, max_pages, l1, l2
    )
    decided = stats_update_decision(
        acted, update_statistics, only_modified, modification_level, incremental, version, edition
    )
    commanded = statistics_command(
        index_command(decided, version, edition, **dict(index_options or {})),
        version, edition, per_partition=incremental, **dict(statistics_options or {}),
    )
    return extended_info(commanded).drop("target_name", "selected")

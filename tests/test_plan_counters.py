"""Counters of partitions in the maintenance plan: what broke by disk on tables 360 times as large."""

import re

from conftest import as_set
from pyspark.sql import functions as F

from fleetlens.plans import index_maintenance
from proxies import QUERIES


def test_counters_of_partitions_are_not_shuffled_by_partition(spark):
    """64 counters of each statistic were shuffled where targets have three partitions."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["index_maintenance_plan_incremental"](spark, "/root/testdata/sf0.001")
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_partition = [x for x in text.splitlines() if re.search(r"Exchange hashpartitioning\(.*partition_number#", x)]
    # What is left: the measurements by index and partition, and the targets that meet them.
    assert by_partition and not any("statistics_id" in x or "stats_id" in x for x in by_partition)


def _targets(rows):
    return rows(
        "object_id long, statistics_id int, partition_number int, is_incremental boolean, row_count long, "
        "modification_counter long",
        (1, 1, 1, True, 100, 7), (1, 1, 2, True, 100, 7), (1, 1, None, True, 100, 7), (1, 2, 1, False, 100, 7),
        (1, None, 1, None, None, None), (2, 1, 3, True, None, None), (3, 1, 1, True, 100, 7), (4, 1, 1, True, 9, 9))


def test_counters_of_partitions_as_a_join_gives_them(spark, rows):
    properties = rows(
        "object_id long, stats_id int, partition_number int, rows long, modification_counter long",
        (1, 1, None, 100, 7), (1, 1, 1, 10, 0), (1, 1, 2, None, 5), (1, 1, 64, 1, 1), (1, 2, 1, 10, 3),
        (2, 1, 3, 8, None), (3, 1, 1, 4, 4), (3, 1, 1, 5, 5), (4, 1, 2, 1, 1), (4, 2, 77, 1, 1))
    targets = _targets(rows)
    asked = index_maintenance._asked_partitions(properties, targets)
    # Without the partitions 64 and 77, and without the statistic as a whole.
    assert sorted({r.partition_number for r in asked.collect()}) == [1, 2, 3] and asked.count() == 7
    got = index_maintenance._with_partition_counters(targets, asked, [])
    assert got.columns == targets.columns
    own = properties.filter("partition_number is not null").select(
        "object_id", F.col("stats_id").alias("statistics_id"), "partition_number", F.col("rows").alias("r"),
        F.col("modification_counter").alias("m"))
    known = F.col("is_incremental") & F.col("r").isNotNull()
    want = targets.join(own, ["object_id", "statistics_id", "partition_number"], "left").select(
        "object_id", "statistics_id", "partition_number", "is_incremental",
        F.when(known, F.col("r")).otherwise(F.col("row_count")).alias("row_count"),
        F.when(known, F.col("m")).otherwise(F.col("modification_counter")).alias("modification_counter"))
    assert as_set(got.fillna(-1)) == as_set(want.fillna(-1)) and got.count() == 9
    # So many different numbers that they are no small list: all counters stay.
    many = spark.range(index_maintenance.BROADCAST_ROWS + 1).select(F.col("id").cast("int").alias("partition_number"))
    assert index_maintenance._asked_partitions(properties, many).count() == 9

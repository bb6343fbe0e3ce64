import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from fleetlens.operators import capacity, counters, waits
from fleetlens.operators.distributed import (
    best_row,
    broadcast_if_small,
    ordered_scan,
    slice_number,
)

DAY = datetime(2024, 1, 1)


def test_first_snapshot_emits_nothing_and_reset_gives_nulls(rows):
    df = rows("k string, ts timestamp, c bigint", ("a", DAY, 10), ("a", DAY + timedelta(hours=1), 15),
              ("a", DAY + timedelta(hours=2), 3), ("a", DAY + timedelta(days=1), 4), ("b", DAY, 1))
    got = counters.successive_delta(df, ["k"], "ts", ["c"]).orderBy("ts").collect()
    assert [(r.c, r.reset) for r in got] == [(5, False), (None, True), (1, False)]


def test_one_reset_counter_voids_all(rows):
    df = rows("k string, ts timestamp, c bigint, d bigint", ("a", DAY, 10, 1),
              ("a", DAY + timedelta(hours=1), 5, 2))
    row = counters.successive_delta(df, ["k"], "ts", ["c", "d"]).first()
    assert (row.c, row.d, row.reset) == (None, None, True)


def test_a_reading_that_is_missing_hides_no_reset(rows):
    hours = [DAY + timedelta(hours=10 * i) for i in range(5)]
    df = rows("k string, ts timestamp, c bigint, d bigint", ("a", hours[0], 10, None), ("a", hours[1], None, 7),
              ("a", hours[2], 4, 9), ("a", hours[3], 4, None), ("a", hours[4], None, 12), ("a", None, 0, 0))
    got = counters.successive_delta(df, ["k"], "ts", ["c", "d"]).orderBy("ts").collect()
    assert [(r.c, r.d, r.reset) for r in got] == [
        (None, None, False), (None, None, True), (0, None, False), (None, 3, False)]
    assert [r.previous_ts for r in got] == hours[:-1]


def test_rows_of_one_time_are_one_reading(rows):
    later = DAY + timedelta(days=2)
    df = rows("k string, ts timestamp, c bigint", (None, DAY, 1), (None, DAY, 3), (None, DAY, None), (None, later, 5),
              (None, later, 4))
    assert as_set(counters.successive_delta(df, ["k"], "ts", ["c"])) == [(None, DAY, later, 2, False)]


def test_elapsed_time_has_no_zone(spark, rows):
    """Across the change to summer time, zone-less stamps are an hour apart, not none."""
    ddl = "object_name string, counter_name string, instance_name string, cntr_value bigint, cntr_type int, collected_time timestamp_ntz"
    name = ("o", "c", "i")
    before = rows(ddl, (*name, 0, counters.RATE_COUNTER, datetime(2024, 3, 31, 1, 30)))
    after = rows(ddl, (*name, 7200, counters.RATE_COUNTER, datetime(2024, 3, 31, 3, 30)))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = counters.perf_counter_rates(before, after, [("o", "c")]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got.cntr_value == 1


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_slices_do_not_change_deltas(spark, unit):
    random.seed(3)
    data = [(random.choice("abc"), DAY + timedelta(minutes=i * 37), random.randint(0, 50))
            for i in range(400)]
    df = spark.createDataFrame(data, "k string, ts timestamp, c bigint")
    whole = counters.successive_delta(df, ["k"], "ts", ["c"], slice_unit=None)
    assert as_set(counters.successive_delta(df, ["k"], "ts", ["c"], unit)) == as_set(whole)


def test_deltas_sum_to_last_minus_first(spark):
    random.seed(5)
    value, data = 0, []
    for i in range(200):
        value += random.randint(0, 9)
        data.append(("k", DAY + timedelta(hours=i), value))
    df = spark.createDataFrame(data, "k string, ts timestamp, c bigint")
    total = counters.successive_delta(df, ["k"], "ts", ["c"]).agg(F.sum("c")).first()[0]
    assert total == data[-1][2] - data[0][2]


def test_snapshot_pair_equals_join(rows):
    ddl = "k string, ts timestamp, c bigint"
    later = DAY + timedelta(minutes=1)
    df = rows(ddl, ("a", DAY, 1), ("a", later, 4), ("b", later, 9), ("c", DAY, 2),
              ("a", later + timedelta(minutes=1), 99))
    joined = counters.snapshot_delta(
        df.filter(F.col("ts") == DAY), df.filter(F.col("ts") == later), ["k"], ["c"]
    )
    pair = counters.snapshot_pair(df, ["k"], "ts", F.lit(DAY), F.lit(later), ["c"])
    assert as_set(counters.pair_delta(pair, ["k"], ["c"])) == as_set(joined) == [("a", 3)]


def _io(rows, *tuples):
    return rows("database_id int, file_id int, num_of_reads bigint, num_of_bytes_read bigint, "
                "io_stall_read_ms bigint, num_of_writes bigint, num_of_bytes_written bigint, "
                "io_stall_write_ms bigint", *tuples)


def test_io_latency_edges(rows):
    files = rows("database_id int, file_id int, name string, physical_name string, type_desc string",
                 (1, 1, "f", "D:\\f", "ROWS"), (1, 2, "g", "D:\\g", "LOG"))
    dbs = rows("database_id int, name string", (1, "db"))
    delta = _io(rows, (1, 1, 3, 1048576, 10, 0, 0, 0), (1, 2, 0, 0, 0, 0, 0, 0))
    got = counters.io_latency_interval(delta, files, dbs).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.read_mb, row.read_pct, row.write_pct) == (Decimal("1.000"), Decimal("100.00"), 0)
    assert (row.avg_read_stall, row.avg_write_stall) == (Decimal("3.333"), Decimal("0.000"))
    assert counters.io_latency_interval(delta, files, dbs, min_bytes=20 * 1048576).count() == 0
    idle = delta.withColumn("io_stall", F.lit(0))
    row = counters.io_latency_cumulative(idle, files, dbs).filter("file_name = 'g'").first()
    assert (row.percent_bytes_read, row.avg_latency_ms, row.avg_io_size_kb) == (None, 0, 0)


def test_capture_id_starts_at_one(rows):
    files = rows("database_id int, file_id int, name string, physical_name string",
                 (1, 1, "f", "D:\\f"))
    dbs = rows("database_id int, name string", (1, "db"))
    stats = _io(rows, (1, 1, 3, 1048576, 10, 2, 0, 0)).withColumns(
        {"io_stall": F.lit(10), "sample_ms": F.lit(1), "size_on_disk_bytes": F.lit(2**21 + 512),
         "file_handle": F.lit(b"x")}
    )
    now = F.lit(DAY)
    empty = rows("capture_id int").limit(0)
    first = counters.io_latency_capture(stats, files, dbs, empty, now)
    assert first.first().capture_id == 1 and first.first().drive == "D:"
    # Guarded on the number of writes, not on their stall.
    assert first.first().write_latency == 0 and first.first().avg_b_per_write == 0
    assert counters.io_latency_capture(stats, files, dbs, first, now).first().capture_id == 2


def test_perf_counters(rows):
    ddl = ("collected_time timestamp, object_name string, counter_name string, instance_name string, "
           "cntr_value bigint, cntr_type int")
    later = DAY + timedelta(milliseconds=2500)
    o = "SQLServer:Databases"
    before = rows(ddl, (DAY, o, "Transactions/sec", "db", 100, counters.RATE_COUNTER),
                  (DAY, o, "Log Flushes/sec", "db", 7, counters.RAW_COUNTER),
                  (DAY, o, "Log Bytes Flushed/sec", "db", 7, 1))
    after = rows(ddl, (later, o, "Transactions/sec", "db", 149, counters.RATE_COUNTER),
                 (later, o, "Log Flushes/sec", "db", 8, counters.RAW_COUNTER),
                 (later, o, "Log Bytes Flushed/sec", "db", 9, 1), (later, o, "Other", "db", 9, 1))
    got = {r.counter_name: r.cntr_value for r in counters.perf_counter_rates(before, after).collect()}
    assert got == {"Transactions/sec": 19, "Log Flushes/sec": 8, "Log Bytes Flushed/sec": None}


def _theta(pairs, threshold):
    """The cut as a running total over every not-lighter name."""
    total = sum(w for _, w in pairs)
    ranked = sorted(pairs, key=lambda p: (-p[1], p[0]))
    kept = []
    for i, (name, weight) in enumerate(ranked):
        upto = sum(w for _, w in ranked[: i + 1])
        if (upto - weight) * 100 < threshold * total:
            kept.append((name, i + 1))
    return sorted(kept)


@pytest.mark.parametrize("bounded", [True, False])
def test_pareto_equals_theta_join_with_ties(spark, bounded):
    random.seed(11)
    pairs = [(f"w{i:03d}", random.choice([0, 1, 1, 1, 5, 80])) for i in range(300)]
    df = spark.createDataFrame([("s", *p) for p in pairs], "server string, name string, w bigint")
    for keys in ([], ["server"]):
        for threshold in (0, 50, 95, 100):
            got = waits.pareto(df, keys, "name", "w", threshold, bounded)
            assert sorted((r.name, r.row_num) for r in got.collect()) == _theta(pairs, threshold)


def test_scan_of_a_hot_key(spark):
    """One key holds most rows, NULL is a key, and slices cut through both."""
    data = [("hot", i) for i in range(2000)] + [("cold", i) for i in range(10)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame(data, "k string, v bigint").repartition(5)
    args = dict(before={"earlier": "v"}, totals={"total": "v"}, position="n")
    for order in (["v"], [("v", True)]):
        spread = ordered_scan(df, ["k"], order, slice_rows=150, **args)
        assert as_nulls(spread) == as_nulls(ordered_scan(df, ["k"], order, bounded=True, **args))


def as_nulls(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_scan_spreads_one_key_over_slices(spark):
    df = spark.range(4000).withColumn("w", F.col("id") % 3)
    number = slice_number(df, [("w", True), "id"], 200)
    sizes = [r["count"] for r in df.groupBy(number.alias("s")).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 1500
    scanned = ordered_scan(df, [], [("w", True), "id"], position="n", slice_rows=200)
    want = sorted((-(i % 3), i) for i in range(4000))
    assert [r.id for r in scanned.orderBy("n").collect()] == [i for _, i in want]
    assert scanned.agg(F.max("n")).first()[0] == 4000


def test_slices_of_all_kinds_of_columns(spark):
    """NULLs, equal leading values, times with and without zone, decimals, texts with quotes."""
    random.seed(8)
    data = [
        (
            random.choice([None, DAY, DAY + timedelta(microseconds=random.randint(0, 10**9))]),
            DAY + timedelta(days=random.randint(0, 3)),
            random.choice([None, DAY.date(), (DAY + timedelta(days=400)).date()]),
            Decimal(random.randint(-5, 5)) / 4,
            random.choice(["", "a'b", 'q"', "\\", None, "é"]),
            random.choice([True, False]),
            i,
        )
        for i in range(600)
    ]
    ddl = "t timestamp, z timestamp_ntz, d date, m decimal(9,2), s string, b boolean, id int"
    df = spark.createDataFrame(data, ddl)
    for order in (["t", "z", "id"], [("t", True), ("d", True), "id"], [("m", True), "s", ("id", True)], ["b", ("z", True), ("s", True), "id"]):
        sliced = ordered_scan(df, [], order, position="n", slice_rows=20)
        assert as_nulls(sliced) == as_nulls(ordered_scan(df, [], order, position="n", bounded=True)), order


def test_pareto_drops_slices_behind_the_cut(spark):
    random.seed(12)
    pairs = [(f"w{i:04d}", random.choice([0, 1, 2, 3, 900, 1000])) for i in range(900)]
    df = spark.createDataFrame(pairs, "name string, w bigint")
    kept = F.col("_h") * 100 < F.col("_t") * 50
    order, sums = [("w", True), "name"], {"before": {"_h": "w"}, "totals": {"_t": "w"}}
    scanned = ordered_scan(df, [], order, **sums, slice_rows=40, until=kept)
    assert 0 < scanned.count() < 400
    whole = ordered_scan(df, [], order, **sums, bounded=True)
    assert as_nulls(scanned.filter(kept)) == as_nulls(whole.filter(kept))


def test_wait_diff_branches(rows):
    ddl = "wait_type string, waiting_tasks_count bigint, wait_time_ms bigint, signal_wait_time_ms bigint"
    before = rows(ddl, ("A", 1, 10, 1), ("B", 5, 50, 5), ("C", 5, 50, 5), ("GONE", 1, 1, 0))
    after = rows(ddl, ("A", 3, 30, 2), ("B", 5, 60, 5), ("C", 6, 50, 5), ("NEW", 0, 7, 0), ("IDLE", 4, 0, 0))
    diff = waits.wait_diff(before, after)
    assert as_set(diff) == [("A", 2, 20, 1), ("NEW", 0, 7, 0)]
    profile = waits.wait_profile_interval(diff)
    new = profile.filter("wait_type = 'NEW'").first()
    assert new.avg_wait_s is None and new.percentage == Decimal("25.93")
    assert [r.wait_type for r in profile.collect()] == ["A", "NEW"]


def test_benign_waits(rows):
    df = rows("wait_type string", ("WAITFOR",), ("PAGEIOLATCH_SH",), (None,))
    assert as_set(waits.exclude_benign(df)) == [("PAGEIOLATCH_SH",)]
    names = rows("n string", ("PAGEIOLATCH_SH",), (None,))
    assert as_set(waits.exclude_benign(df, "wait_type", names)) == [("WAITFOR",)]
    assert len(waits.BENIGN_WAITS) == len(set(waits.BENIGN_WAITS)) == 78


def test_best_row_prefers_known_values(rows):
    df = rows("k int, a int, b int, c string", (1, None, 9, "x"), (1, 2, 1, "y"), (1, 2, 1, "z"), (2, None, None, "n"))
    assert as_set(best_row(df, ["k"], ["a", "b"])) == [(1, 2, 1, "z"), (2, None, None, "n")]


def test_broadcast_only_below_the_limit(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(broadcast_if_small(spark.range(10), 10))
    assert not hinted(broadcast_if_small(spark.range(11), 10))


def test_log_space_golden(rows):
    used = 3568 * 1048576 + 90112  # 3568.0859375 MB
    df = rows("total_log_size_in_bytes bigint, used_log_space_in_bytes bigint, used_log_space_in_percent float",
              (3583 * 1048576 + 1015808, used, 99.55618))
    row = capacity.log_space(df).first()
    assert (row.total_log_size_mb, row.free_space_mb) == (3583, 15)
    assert row.used_log_space_mb == Decimal("3568.08593750")


def test_resource_database_and_growth_texts(rows):
    pages = rows("database_id int, is_modified boolean", (32767, True), (32767, False), (5, True))
    dbs = rows("database_id int, name string", (5, "five"))
    assert as_set(capacity.buffer_pool_by_db(pages, dbs).select("database_name", "dirty_page_count")) == [
        ("Resource Database", 1), ("five", 1)]
    trace = rows("database_id int, database_name string, file_name string, event_class int, "
                 "integer_data bigint, start_time timestamp, duration bigint",
                 (5, "five", "f", 92, 128, DAY, 1_500_000), (5, "five", "f", 1, 128, DAY, 1))
    events = rows("trace_event_id int, name string", (92, "Data File Auto Grow"), (1, "Other"))
    files = rows("database_id int, name string, physical_name string, type int, growth int, "
                 "is_percent_growth boolean, size int, max_size int", (5, "f", "p", 0, 100, True, 256, -1))
    row = capacity.autogrow_history(trace, events, files).first()
    assert (row.auto_grow_setting, row.max_file_size, row.file_type) == ("100%", "Unlimited", "Row")
    assert (row.auto_grow_size_mb, row.event_duration_s) == (Decimal("1.00"), Decimal("1.50"))

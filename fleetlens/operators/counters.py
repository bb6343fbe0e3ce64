"""Counter snapshots, I/O latency and performance counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.numbers import elapsed_micros, int_div, ratio
from fleetlens.operators.distributed import BROADCAST_ROWS, all_of

IO_COUNTER_COLUMNS = [
    "num_of_reads",
    "num_of_bytes_read",
    "io_stall_read_ms",
    "num_of_writes",
    "num_of_bytes_written",
    "io_stall_write_ms",
]

# The I/O counters to sample, as (object, counter).
IO_PERFORMANCE_COUNTERS = [
    ("SQLServer:Buffer Manager", "Checkpoint pages/sec"),
    ("SQLServer:Buffer Manager", "Background writer pages/sec"),
    ("SQLServer:Buffer Manager", "Lazy writes/sec"),
    ("SQLServer:Buffer Manager", "Page reads/sec"),
    ("SQLServer:Buffer Manager", "Page writes/sec"),
    ("SQLServer:Buffer Manager", "Readahead pages/sec"),
    ("SQLServer:Databases", "Log Flushes/sec"),
    ("SQLServer:Databases", "Log Bytes Flushed/sec"),
    ("SQLServer:Databases", "Log Flush Write Time (ms)"),
    ("SQLServer:Databases", "Transactions/sec"),
    ("SQLServer:SQL Statistics", "Batch Requests/sec"),
]

# Counter type codes (cumulative per-second counter, point-in-time value).
RATE_COUNTER = 272696576
RAW_COUNTER = 65792


def snapshot_delta(
    before: DataFrame,
    after: DataFrame,
    on: Sequence[str],
    counters: Sequence[str],
) -> DataFrame:
    """``after - before`` per counter for the keys present in both snapshots."""
    old = before.select(*on, *[F.col(c).alias(f"_before_{c}") for c in counters])
    return after.join(old, list(on)).select(
        *on, *[(F.col(c) - F.col(f"_before_{c}")).alias(c) for c in counters]
    )


def snapshot_pair(
    snapshots: DataFrame,
    on: Sequence[str],
    ts: str,
    before_at,
    after_at,
    counters: Sequence[str],
) -> DataFrame:
    """Two snapshots of one landed table side by side, from a single scan.

    The two instants reach the scan as a filter, and one aggregation replaces the self-join.
    Columns: ``on``, ``has_before``, ``has_after``, ``before_<c>``, ``after_<c>``.
    """
    first, second = F.col(ts) == before_at, F.col(ts) == after_at

    def pick(c: str, when: Column, name: str) -> Column:
        return F.max(F.when(when, F.col(c))).alias(f"{name}_{c}")

    return (
        snapshots.filter(first | second)
        .groupBy(*on)
        .agg(
            F.bool_or(first).alias("has_before"),
            F.bool_or(second).alias("has_after"),
            *[pick(c, first, "before") for c in counters],
            *[pick(c, second, "after") for c in counters],
        )
    )


def pair_delta(pair: DataFrame, on: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """:func:`snapshot_delta` on the output of :func:`snapshot_pair`."""
    return pair.filter("has_before and has_after").select(
        *on, *[(F.col(f"after_{c}") - F.col(f"before_{c}")).alias(c) for c in counters]
    )


def readings(df: DataFrame, keys: Sequence[str], ts: str, counters: Sequence[str]) -> DataFrame:
    """One row per key and time with the greatest known value of each counter.

    So repeated and contradicting rows of one instant count the same in any order of arrival.  Rows
    without a time cannot be ordered and are left out.
    """
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, ts)
        .agg(*[F.max(c).alias(c) for c in counters])
    )


def successive_delta(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    counters: Sequence[str],
    slice_unit: str | None = "day",
) -> DataFrame:
    """Delta of every snapshot to the last known values of the same key.

    The first snapshot of a key emits nothing.  Each counter is compared with the last value that
    was read of it: a NULL reading has a NULL delta and is skipped by the next one, so it hides no
    reset.  When any counter went down the counters were reset: all deltas are NULL and ``reset`` is
    true.  Several rows of one key and time are one snapshot (:func:`readings`); rows without a
    time are left out.

    A key is scanned in time slices (``slice_unit``: a ``date_trunc`` unit), so a key with a very
    long history is not one task.  What a slice knows at its end, the last value per counter, is an
    aggregate; the known values are carried over the slices of a key and into each of them.
    ``slice_unit=None`` uses one slice per key.
    """
    keys, counters = list(keys), list(counters)
    known = [f"_known_{i}" for i in range(len(counters))]
    part = F.lit(0) if slice_unit is None else F.date_trunc(slice_unit, F.col(ts))
    in_slice = [*keys, "_slice"]
    # Dealt by slice once: the readings, the windows and the ends of the slices use it.
    dealt = df.select(*keys, ts, *counters, part.alias("_slice")).repartition(*in_slice)
    rows = readings(dealt, in_slice, ts, counters)
    ends = rows.groupBy(*in_slice).agg(
        F.max(ts).alias("_time"),
        *[
            F.max(F.when(F.col(c).isNotNull(), F.struct(ts, F.col(c).alias("value"))))["value"].alias(k)
            for c, k in zip(counters, known)
        ],
    )
    # One row per key and slice: the history of a key in slices is short.
    earlier = _before(keys, "_slice")
    carry = ends.select(
        *[F.col(c).alias(f"_on_{i}") for i, c in enumerate(in_slice)],
        F.lag("_time").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry_time"),
        *[F.last(k, ignorenulls=True).over(earlier).alias(f"_carry{k}") for k in known],
    )
    inside = _before(in_slice, ts)
    same = all_of(*[F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(in_slice)])
    joined = (
        rows.withColumns({k: F.last(c, ignorenulls=True).over(inside) for c, k in zip(counters, known)})
        .withColumn("_time", F.last(ts).over(inside))
        .join(carry, same)
        .withColumn("_previous", F.coalesce("_time", "_carry_time"))
    )
    change = [F.col(c) - F.coalesce(k, f"_carry{k}") for c, k in zip(counters, known)]
    return (
        joined.filter(F.col("_previous").isNotNull())
        .withColumn("reset", F.least(F.lit(0), *change) < 0)
        .select(
            *keys,
            F.col("_previous").alias(f"previous_{ts}"),
            ts,
            *[F.when(~F.col("reset"), d).alias(c) for d, c in zip(change, counters)],
            "reset",
        )
    )


def _before(keys: Sequence[str], order: str):
    """The rows of the same keys that come before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _thousandths(total: str, count: str) -> Column:
    return ratio(total, count, 12, 3, on_zero=0)


def io_latency_interval(
    delta: DataFrame,
    files: DataFrame,
    dbs: DataFrame,
    keys: Sequence[str] = (),
    min_bytes: int = 0,
    carry: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Read/write volume, shares and average stall per file over an interval.

    ``delta`` is the output of :func:`snapshot_delta` over :data:`IO_COUNTER_COLUMNS`.  Files whose
    traffic is not above ``min_bytes`` are dropped.  ``carry`` lists further columns of ``delta`` to
    show (for example the interval).
    """
    traffic = "(num_of_bytes_read + num_of_bytes_written)"
    names = files.select(*keys, "database_id", "file_id", F.col("name").alias("file_name"),
                         F.col("physical_name").alias("file_path"),
                         F.col("type_desc").alias("file_type"))
    owners = dbs.select(*keys, "database_id", F.col("name").alias("database_name"))
    out = (
        delta.filter(F.expr(traffic) > min_bytes)
        .join(names, [*keys, "database_id", "file_id"])
        .join(owners, [*keys, "database_id"])
        .select(
            *keys,
            *carry,
            "database_id",
            "file_id",
            "database_name",
            "file_name",
            "file_path",
            "file_type",
            F.col("num_of_reads").alias("reads"),
            ratio("num_of_bytes_read", 1048576, 12, 3).alias("read_mb"),
            ratio("num_of_bytes_written", 1048576, 12, 3).alias("written_mb"),
            F.col("num_of_writes").alias("writes"),
            (F.col("num_of_reads") + F.col("num_of_writes")).alias("io_count"),
            ratio("num_of_bytes_read", traffic, 5, 2, factor=100).alias("read_pct"),
            ratio("num_of_bytes_written", traffic, 5, 2, factor=100).alias("write_pct"),
            F.col("io_stall_read_ms").alias("read_stall"),
            F.col("io_stall_write_ms").alias("write_stall"),
            _thousandths("io_stall_read_ms", "num_of_reads").alias("avg_read_stall"),
            _thousandths("io_stall_write_ms", "num_of_writes").alias("avg_write_stall"),
        )
    )
    return out.orderBy(*keys, *carry, "database_id", "file_id") if ordered else out


def _per_op(total, count) -> Column:
    return F.coalesce(int_div(total, count), F.lit(0))


def io_latency_cumulative(
    stats: DataFrame,
    files: DataFrame,
    dbs: DataFrame,
    keys: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Byte shares and average latency / size per read, write and transfer since server start.

    Everything is integer division; shares of a file without traffic are NULL.
    """
    reads, writes = F.col("num_of_reads"), F.col("num_of_writes")
    read, written = F.col("num_of_bytes_read"), F.col("num_of_bytes_written")
    names = files.select(*keys, "database_id", "file_id", F.col("name").alias("file_name"),
                         "type_desc", "physical_name")
    owners = dbs.select(*keys, "database_id", F.col("name").alias("database_name"))
    out = (
        stats.join(names, [*keys, "database_id", "file_id"])
        .join(owners, [*keys, "database_id"], "left")
        .select(
            *keys,
            "database_name",
            "file_name",
            F.col("type_desc").alias("file_type"),
            reads.alias("num_reads"),
            writes.alias("num_writes"),
            read.alias("read_bytes"),
            written.alias("write_bytes"),
            int_div(read * 100, read + written).alias("percent_bytes_read"),
            int_div(written * 100, read + written).alias("percent_bytes_write"),
            _per_op("io_stall_read_ms", reads).alias("avg_read_latency_ms"),
            int_div(_per_op(read, reads), 1024).alias("avg_read_size_kb"),
            _per_op("io_stall_write_ms", writes).alias("avg_write_latency_ms"),
            int_div(_per_op(written, writes), 1024).alias("avg_write_size_kb"),
            _per_op("io_stall", reads + writes).alias("avg_latency_ms"),
            int_div(_per_op(read + written, reads + writes), 1024).alias("avg_io_size_kb"),
            "physical_name",
        )
    )
    return out.orderBy(F.desc("avg_latency_ms"), *keys, "physical_name") if ordered else out


def io_latency_capture(
    stats: DataFrame,
    files: DataFrame,
    dbs: DataFrame,
    history: DataFrame,
    captured_at: Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One capture of file latencies, ready to append to ``history``.

    The capture id is one above the greatest id in ``history``; it is advisory and needs a single
    writer.  Averages are 0 for a file without operations of that kind.
    """
    reads, writes = F.col("num_of_reads"), F.col("num_of_writes")
    read, written = F.col("num_of_bytes_read"), F.col("num_of_bytes_written")
    next_id = F.coalesce(history.select(F.max("capture_id")).scalar(), F.lit(0)) + 1
    owners = dbs.select(*keys, "database_id", F.col("name").alias("db"))
    paths = files.select(*keys, "database_id", "file_id", "physical_name")
    return (
        stats.join(paths, [*keys, "database_id", "file_id"])
        .join(owners, [*keys, "database_id"], "left")
        .select(
            next_id.cast("int").alias("capture_id"),
            captured_at.alias("capture_date"),
            *keys,
            _per_op("io_stall_read_ms", reads).alias("read_latency"),
            _per_op("io_stall_write_ms", writes).alias("write_latency"),
            _per_op("io_stall", reads + writes).alias("latency"),
            _per_op(read, reads).alias("avg_b_per_read"),
            _per_op(written, writes).alias("avg_b_per_write"),
            _per_op(read + written, reads + writes).alias("avg_b_per_transfer"),
            F.left("physical_name", F.lit(2)).alias("drive"),
            "db",
            "database_id",
            "file_id",
            "sample_ms",
            "num_of_reads",
            "num_of_bytes_read",
            "io_stall_read_ms",
            "num_of_writes",
            "num_of_bytes_written",
            "io_stall_write_ms",
            "io_stall",
            ratio("size_on_disk_bytes div 1024", 1024, 25, 6).alias("size_on_disk_mb"),
            "file_handle",
            "physical_name",
        )
    )


def _instant(df: DataFrame, column: str) -> Column:
    """A timestamp column as it is; anything else as a timestamp."""
    kind = df.schema[column].dataType
    return F.col(column) if isinstance(kind, T.TimestampNTZType) else F.col(column).cast("timestamp")


def perf_counter_rates(
    before: DataFrame,
    after: DataFrame,
    wanted: Sequence[tuple[str, str]] = tuple(IO_PERFORMANCE_COUNTERS),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per-second rate of cumulative counters, raw value of instantaneous ones, NULL otherwise.

    ``wanted`` is the list of (object, counter) to keep.
    """
    spark = after.sparkSession
    schema = T.StructType(
        [T.StructField("object_name", T.StringType()), T.StructField("counter_name", T.StringType())]
    )
    listed = spark.createDataFrame([tuple(w) for w in wanted], schema)
    # A literal list: its length is known here.
    names = F.broadcast(listed) if len(wanted) <= BROADCAST_ROWS else listed
    identity = [*keys, "object_name", "counter_name", "instance_name"]
    old = before.select(*identity, F.col("cntr_value").alias("_old"),
                        _instant(before, "collected_time").alias("_since"))
    after = after.withColumn("_until", _instant(after, "collected_time"))
    elapsed_ms = int_div(elapsed_micros("_since", "_until"), 1000)
    value = F.when(
        F.col("cntr_type") == RATE_COUNTER,
        int_div((F.col("cntr_value") - F.col("_old")) * 1000, elapsed_ms),
    ).when(F.col("cntr_type") == RAW_COUNTER, F.col("cntr_value"))
    return (
        after.join(names, ["object_name", "counter_name"], "left_semi")
        .join(old, identity)
        .select(*identity, value.alias("cntr_value"))
    )


def page_compression_success(
    op_stats: DataFrame,
    indexes: DataFrame,
    partitions: DataFrame,
    keys: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Share of page compression attempts that succeeded, for page-compressed partitions."""
    # Code 2 is page compression.
    compressed = partitions.filter("data_compression = 2")
    named = indexes.select(*keys, "object_id", "index_id", "table_name",
                           F.col("name").alias("index_name"))
    out = (
        op_stats.filter("page_compression_attempt_count > 0")
        .join(compressed, [*keys, "object_id", "partition_number"], "left_semi")
        .join(named, [*keys, "object_id", "index_id"])
        .select(
            *keys,
            "table_name",
            "index_name",
            "partition_number",
            "page_compression_attempt_count",
            "page_compression_success_count",
            ratio("page_compression_success_count", "page_compression_attempt_count", 12, 6)
            .alias("success_rate"),
        )
        .distinct()
    )
    return out.orderBy("success_rate", *keys, "table_name", "index_name") if ordered else out

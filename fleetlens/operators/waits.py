"""Wait statistics: benign-wait exclusion, Pareto cut, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import ratio
from fleetlens.operators.counters import snapshot_pair
from fleetlens.operators.distributed import BROADCAST_ROWS, ordered_scan

# Wait types that are almost never a problem (idle and background waits).
BENIGN_WAITS = """
BROKER_EVENTHANDLER BROKER_RECEIVE_WAITFOR BROKER_TASK_STOP BROKER_TO_FLUSH BROKER_TRANSMITTER
CHECKPOINT_QUEUE CHKPT CLR_AUTO_EVENT CLR_MANUAL_EVENT CLR_SEMAPHORE CXCONSUMER
DBMIRROR_DBM_EVENT DBMIRROR_EVENTS_QUEUE DBMIRROR_WORKER_QUEUE DBMIRRORING_CMD DIRTY_PAGE_POLL
DISPATCHER_QUEUE_SEMAPHORE EXECSYNC FSAGENT FT_IFTS_SCHEDULER_IDLE_WAIT FT_IFTSHC_MUTEX
HADR_CLUSAPI_CALL HADR_FILESTREAM_IOMGR_IOCOMPLETION HADR_LOGCAPTURE_WAIT
HADR_NOTIFICATION_DEQUEUE HADR_TIMER_TASK HADR_WORK_QUEUE KSOURCE_WAKEUP LAZYWRITER_SLEEP
LOGMGR_QUEUE MEMORY_ALLOCATION_EXT ONDEMAND_TASK_QUEUE PARALLEL_REDO_DRAIN_WORKER
PARALLEL_REDO_LOG_CACHE PARALLEL_REDO_TRAN_LIST PARALLEL_REDO_WORKER_SYNC
PARALLEL_REDO_WORKER_WAIT_WORK PREEMPTIVE_OS_FLUSHFILEBUFFERS PREEMPTIVE_XE_GETTARGETSTATE
PVS_PREALLOCATE PWAIT_ALL_COMPONENTS_INITIALIZED PWAIT_DIRECTLOGCONSUMER_GETNEXT
PWAIT_EXTENSIBILITY_CLEANUP_TASK QDS_PERSIST_TASK_MAIN_LOOP_SLEEP QDS_ASYNC_QUEUE
QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP QDS_SHUTDOWN_QUEUE REDO_THREAD_PENDING_WORK
REQUEST_FOR_DEADLOCK_SEARCH RESOURCE_QUEUE SERVER_IDLE_CHECK SLEEP_BPOOL_FLUSH SLEEP_DBSTARTUP
SLEEP_DCOMSTARTUP SLEEP_MASTERDBREADY SLEEP_MASTERMDREADY SLEEP_MASTERUPGRADED
SLEEP_MSDBSTARTUP SLEEP_SYSTEMTASK SLEEP_TASK SLEEP_TEMPDBSTARTUP SNI_HTTP_ACCEPT
SOS_WORK_DISPATCHER SP_SERVER_DIAGNOSTICS_SLEEP SQLTRACE_BUFFER_FLUSH
SQLTRACE_INCREMENTAL_FLUSH_SLEEP SQLTRACE_WAIT_ENTRIES VDI_CLIENT_OTHER WAIT_FOR_RESULTS WAITFOR
WAITFOR_TASKSHUTDOWN WAIT_XTP_RECOVERY WAIT_XTP_HOST_WAIT WAIT_XTP_OFFLINE_CKPT_NEW_LOG
WAIT_XTP_CKPT_CLOSE XE_DISPATCHER_JOIN XE_DISPATCHER_WAIT XE_TIMER_EVENT
""".split()

# Fixed value: prefix of the help page of a wait type.
WAIT_HELP_URL = "https://www.sqlskills.com/help/waits/"

WAIT_COUNTERS = ["waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms"]


def exclude_benign(
    df: DataFrame, col: str = "wait_type", names: Sequence[str] | DataFrame = tuple(BENIGN_WAITS)
) -> DataFrame:
    """Rows whose ``col`` is not in ``names``; rows with a NULL name are dropped, as by NOT IN.

    ``names`` is a literal list (a pushed-down filter) or a one-column DataFrame (an anti join that
    Spark broadcasts or shuffles by its size).  A NULL in it excludes nothing, in either form.
    """
    if isinstance(names, DataFrame):
        listed = names.select(F.col(names.columns[0]).alias(col))
        return df.filter(F.col(col).isNotNull()).join(listed, col, "left_anti")
    names = [n for n in names if n is not None]
    if len(names) > BROADCAST_ROWS:
        return exclude_benign(df, col, df.sparkSession.createDataFrame([(n,) for n in names], [col]))
    return df.filter(~F.col(col).isin(*names)) if names else df.filter(F.col(col).isNotNull())


def pareto(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    weight: str,
    threshold: int = 95,
    bounded: bool = False,
) -> DataFrame:
    """The heaviest names that together reach ``threshold`` percent of the weight of their key.

    A row is kept while the share of the rows *before* it is below the threshold, so the row that
    crosses it is kept.  Equal weights are ranked by name.  ``name`` must be unique per key and
    ``weight`` a non-negative integer.  Only the slices of weights that hold kept rows are sorted.  Adds ``percentage`` and ``row_num``.  ``bounded`` as in
    :func:`~fleetlens.operators.distributed.ordered_scan`.
    """
    wide = "decimal(38,0)"
    kept = F.col("_heavier").cast(wide) * 100 < F.col("_total").cast(wide) * threshold
    ranked = ordered_scan(
        df,
        keys,
        [(weight, True), name],
        before={"_heavier": weight},
        totals={"_total": weight},
        position="row_num",
        bounded=bounded,
        until=kept,
    )
    return (
        ranked.filter(kept)
        .withColumn("percentage", ratio(weight, "_total", 5, 2, factor=100))
        .drop("_heavier", "_total")
    )


def _profile(df: DataFrame, keys: Sequence[str], threshold: int, bounded: bool) -> DataFrame:
    kept = pareto(df, keys, "wait_type", "wait_time_ms", threshold, bounded)
    resource = "(wait_time_ms - signal_wait_time_ms)"

    def seconds(ms):
        return ratio(ms, 1000, 16, 2)

    def average(ms):
        return ratio(ms, "(waiting_tasks_count * 1000)", 16, 4)

    return kept.select(
        *keys,
        "wait_type",
        seconds("wait_time_ms").alias("wait_s"),
        seconds(resource).alias("resource_s"),
        seconds("signal_wait_time_ms").alias("signal_s"),
        F.col("waiting_tasks_count").alias("wait_count"),
        "percentage",
        average("wait_time_ms").alias("avg_wait_s"),
        average(resource).alias("avg_res_s"),
        average("signal_wait_time_ms").alias("avg_sig_s"),
        "row_num",
    )


def wait_profile(
    stats: DataFrame,
    keys: Sequence[str] = (),
    benign: Sequence[str] = tuple(BENIGN_WAITS),
    threshold: int = 95,
    bounded: bool = True,
) -> DataFrame:
    """Top waits since server start: seconds, counts, share, averages and a help address.

    One key is one server (and instant); its wait types are a fixed, small set, hence ``bounded``.
    """
    active = exclude_benign(stats, "wait_type", benign).filter("waiting_tasks_count > 0")
    out = _profile(active, keys, threshold, bounded)
    return out.withColumn("help_url", F.concat(F.lit(WAIT_HELP_URL), F.col("wait_type")))


def _changed(pair: DataFrame, on: Sequence[str]) -> DataFrame:
    """Waits of an interval from ``before_*`` / ``after_*`` columns (see :func:`wait_diff`)."""
    change = {c: F.col(f"after_{c}") - F.when(F.col("has_before"), F.col(f"before_{c}"))
              .otherwise(F.lit(0)) for c in WAIT_COUNTERS}
    new = ~F.col("has_before") & (F.col("after_wait_time_ms") > 0)
    grown = (
        F.col("has_before")
        & (change["waiting_tasks_count"] > 0)
        & (change["wait_time_ms"] > 0)
    )
    return (
        pair.filter("has_after")
        .filter(new | grown)
        .select(*on, *[change[c].alias(c) for c in WAIT_COUNTERS])
    )


def wait_diff(before: DataFrame, after: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Waits between two snapshots.

    A wait that is new in ``after`` counts in full when it has time; one present in both counts by
    its difference when both its count and its time grew.  Equal rows appear once.
    """
    on = [*keys, "wait_type"]
    old = before.select(*on, *[F.col(c).alias(f"before_{c}") for c in WAIT_COUNTERS],
                        F.lit(True).alias("_present"))
    pair = (
        after.select(*on, *[F.col(c).alias(f"after_{c}") for c in WAIT_COUNTERS])
        .join(old, on, "left")
        .withColumns({"has_before": F.col("_present").isNotNull(), "has_after": F.lit(True)})
    )
    return _changed(pair, on).distinct()


def wait_diff_between(
    snapshots: DataFrame, before_at, after_at, keys: Sequence[str] = (), ts: str = "snapshot_ts"
) -> DataFrame:
    """:func:`wait_diff` of two instants of one landed table, in a single scan.

    The aggregation leaves one row per wait, so nothing is left to de-duplicate.
    """
    on = [*keys, "wait_type"]
    return _changed(snapshot_pair(snapshots, on, ts, before_at, after_at, WAIT_COUNTERS), on)


def wait_diff_of_pair(pair: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """:func:`wait_diff` of snapshots that are already side by side (``snapshot_pair`` layout).

    ``pair`` holds one row per key and wait.
    """
    return _changed(pair, [*keys, "wait_type"])


def wait_profile_interval(
    diff: DataFrame,
    keys: Sequence[str] = (),
    benign: Sequence[str] = tuple(BENIGN_WAITS),
    threshold: int = 95,
    bounded: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Top waits of an interval, from the output of :func:`wait_diff`.

    A new wait without tasks has NULL averages.
    """
    out = _profile(exclude_benign(diff, "wait_type", benign), keys, threshold, bounded)
    return out.orderBy(*keys, F.desc("percentage"), "row_num") if ordered else out

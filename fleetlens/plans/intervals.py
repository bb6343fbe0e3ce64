"""Interval analyses of landed counter snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fleetlens.operators.counters import (
    IO_COUNTER_COLUMNS,
    io_latency_interval,
    pair_delta,
    snapshot_pair,
    successive_delta,
)
from fleetlens.operators.waits import BENIGN_WAITS, wait_diff_between, wait_profile_interval


def waits_between(
    snapshots: DataFrame,
    before_at,
    after_at,
    keys: Sequence[str] = ("server",),
    benign: Sequence[str] = tuple(BENIGN_WAITS),
    threshold: int = 95,
    ts: str = "snapshot_ts",
    bounded: bool = True,
) -> DataFrame:
    """Top waits of every server between two instants: one scan, one shuffle per grain."""
    diff = wait_diff_between(snapshots, before_at, after_at, keys, ts)
    return wait_profile_interval(diff, keys, benign, threshold, bounded)


def file_latency_between(
    snapshots: DataFrame,
    files: DataFrame,
    dbs: DataFrame,
    before_at,
    after_at,
    keys: Sequence[str] = ("server",),
    min_bytes: int = 20 * 1048576,
    ts: str = "snapshot_ts",
) -> DataFrame:
    """File latency of every server between two instants."""
    on = [*keys, "database_id", "file_id"]
    pair = snapshot_pair(snapshots, on, ts, before_at, after_at, IO_COUNTER_COLUMNS)
    return io_latency_interval(
        pair_delta(pair, on, IO_COUNTER_COLUMNS), files, dbs, keys, min_bytes
    )


def file_latency_series(
    snapshots: DataFrame,
    files: DataFrame,
    dbs: DataFrame,
    keys: Sequence[str] = ("server",),
    min_bytes: int = 20 * 1048576,
    ts: str = "snapshot_ts",
    slice_unit: str | None = "day",
) -> DataFrame:
    """File latency between every two successive snapshots; intervals with a reset are left out."""
    on = [*keys, "database_id", "file_id"]
    deltas = successive_delta(snapshots, on, ts, IO_COUNTER_COLUMNS, slice_unit).filter("not reset")
    return io_latency_interval(
        deltas, files, dbs, keys, min_bytes, carry=[f"previous_{ts}", ts]
    )

"""Keyed streaming operators that work in event-time order, whatever order the rows arrive in.

A row waits in the state of its bucket of keys until the watermark has passed its time; then no earlier row
can come any more, and all rows that are due leave in time order.  So the result does not depend on
how the input is cut into files and batches, and equals that of the batch operator over the same
rows.  Rows behind the watermark are late and are dropped; the last rows of a stream stay until
something newer arrives.  A source that falls silent can send heartbeats: rows with a time and a
flag (``beat``) that only move the watermark.

State is kept in RocksDB, for buckets of keys that are handled together: a bucket's new rows are
appended as a block without reading those that wait, and all its keys are released in one pass.  Call
:func:`use_ordered_state` before such a stream starts.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.numbers import from_micros, micros_of
from fleetlens.operators.alerts import greedy_thinning
from fleetlens.operators.events import login_failures, shred_events

_MICROS_PER_MS = 1000
_OPERATORS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le,
              "=": operator.eq}
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_ordered_state(spark: SparkSession) -> None:
    """Let the session keep streaming state in RocksDB, as lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


#: Keys share so many states: what a state costs by itself, in every batch, does not grow with the keys.
BUCKETS = 1024


def _pack(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(block)).read_pandas()


class InTimeOrder(StatefulProcessor):
    """Rows of a bucket of keys, kept in blocks until the watermark passes them.

    ``keys`` are the columns that tell the keys of a bucket apart, ``us`` is the time.  ``release``
    gets the rows that are due as a frame (unordered, with everything up to the watermark), and the
    carried rows, at most one per key, or None; it returns the rows to emit and the new carried ones.
    """

    def __init__(self, keys: Sequence[str], values: Sequence[str], silence_ms: int | None = None) -> None:
        self._by = list(keys)
        self._names = [*keys, "us", *values]
        self._silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "first long, block binary")
        self._carried = handle.getValueState("carried", "block binary")
        self._wake = handle.getValueState("wake", "ms long")

    def release(self, rows: pd.DataFrame, carried: pd.DataFrame | None):
        raise NotImplementedError

    def _codes(self, frame: pd.DataFrame) -> np.ndarray:
        """A number per key."""
        if not self._by:
            return np.zeros(len(frame), np.int64)
        return frame.groupby(self._by, dropna=False, sort=False).ngroup().to_numpy()

    def _wake_at(self, ms: int, now: int | None) -> None:
        """One timer per bucket: the earliest."""
        if now is not None:
            if now <= ms:
                return
            self._handle.deleteTimer(now)
        self._handle.registerTimer(ms)
        self._wake.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * _MICROS_PER_MS
        blocks = []
        for batch in rows:
            fresh = batch.loc[batch["us"] > passed, self._names]
            if len(fresh):
                blocks.append((int(fresh["us"].min()), _pack(fresh)))
        if blocks:
            self._waiting.appendList(blocks)
            now = self._wake.get()
            earliest = min(first for first, _ in blocks)
            self._wake_at(-(-earliest // _MICROS_PER_MS), now[0] if now else None)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = watermark * _MICROS_PER_MS
        self._wake.clear()
        due, left = [], []
        for first, block in self._waiting.get():
            if first > passed:
                left.append((first, block))
                continue
            rows = _unpack(block)
            waits = rows["us"] > passed
            if waits.any():
                left.append((int(rows.loc[waits, "us"].min()), _pack(rows[waits])))
                rows = rows[~waits]
            due.append(rows)
        kept = self._carried.get()
        carried = _unpack(kept[0]) if kept is not None else None
        out = None
        if due:
            self._waiting.clear()
            if left:
                self._waiting.put(left)
            out, carried = self.release(pd.concat(due, ignore_index=True), carried)
        if carried is not None:
            if self._silence_ms is not None:
                forget = carried["us"] // _MICROS_PER_MS + self._silence_ms
                carried = carried[forget >= watermark]
                if len(carried) and not left:
                    self._wake_at(int(forget.max()) + 1, None)
            if len(carried):
                self._carried.update((_pack(carried),))
            elif kept is not None:
                self._carried.clear()
        if left:
            self._wake_at(-(-min(first for first, _ in left) // _MICROS_PER_MS), None)
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def last_known(values: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """For every row and column, the last row up to it with a value, or -1."""
    at = np.where(missing, -1, np.arange(len(values))[:, None])
    return np.maximum.accumulate(at, axis=0)


class _Deltas(InTimeOrder):
    def __init__(self, keys: Sequence[str], counters: int, silence_ms: int | None) -> None:
        self._counters = range(counters)
        super().__init__(keys, [f"{c}{i}" for i in self._counters for c in "cn"], silence_ms)

    def release(self, rows: pd.DataFrame, carried: pd.DataFrame | None):
        frame = rows if carried is None else pd.concat([carried, rows], ignore_index=True)
        code, us = self._codes(frame), frame["us"].to_numpy(np.int64)
        values = np.stack([frame[f"c{i}"].to_numpy(np.int64) for i in self._counters], axis=1)
        missing = np.stack([frame[f"n{i}"].to_numpy(bool) for i in self._counters], axis=1)
        # Rows of one key and time are one reading, with the greatest value of each counter.
        order = np.lexsort((us, code))
        code, us, values, missing = code[order], us[order], values[order], missing[order]
        values = np.where(missing, np.iinfo(np.int64).min, values)
        first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(us) != 0)))
        code, us, place = code[first], us[first], order[first]
        values = np.maximum.reduceat(values, first)
        missing = np.logical_and.reduceat(missing, first)
        # Where a key begins, or begins anew, nothing is known of the time before.
        other = np.diff(code) != 0
        anew = np.append(True, other)
        if self._silence_ms is not None:
            anew[1:] |= np.diff(us) > self._silence_ms * _MICROS_PER_MS
        since = np.maximum.accumulate(np.where(anew, np.arange(len(us)), 0))
        at = last_known(values, missing)
        at = np.where(at >= since[:, None], at, -1)
        columns = np.arange(len(self._counters))
        unknown = missing[1:] | (at[:-1] < 0)
        change = np.where(unknown, 0, values[1:] - values[at[:-1], columns])
        reset = (change < 0).any(axis=1)
        follows = np.flatnonzero(~anew[1:])
        out = frame[self._by].iloc[place[1:][follows]].reset_index(drop=True)
        out["_previous_us"], out["_us"] = us[follows], us[follows + 1]
        for i in self._counters:
            out[f"c{i}"] = pd.arrays.IntegerArray(change[follows, i], (unknown[:, i] | reset)[follows])
        out["reset"] = reset[follows]
        last = np.flatnonzero(np.append(other, True))
        known = frame[self._by].iloc[place[last]].reset_index(drop=True)
        known["us"] = us[last]
        for i in self._counters:
            never = at[last, i] < 0
            known[f"c{i}"] = np.where(never, 0, values[at[last, i], i])
            known[f"n{i}"] = never
        return out, known


def _timed(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Event time as microseconds ``us``, and watermarked."""
    us = micros_of(ts, stream.schema[ts].dataType)
    return stream.withColumn("us", us).withColumn("_event_time", F.timestamp_micros("us")).withWatermark(
        "_event_time", watermark
    )


def _with_time(beat: str | None, condition: Column | None = None) -> Column:
    """The condition for rows that count.  It reads the event time, so that Spark does not move it
    below the watermark, which all rows shall move."""
    counts = condition if condition is not None else F.lit(True)
    if beat is not None:
        counts = counts & ~F.col(beat)
    return F.when(F.col("_event_time").isNotNull(), counts)


def _in_buckets(rows: DataFrame, keys: Sequence[str], values: Sequence[Column], processor, result: str) -> DataFrame:
    """The ``result`` columns of the processor over the buckets of the keys, behind the keys.

    Keys are atomic values.  Numbers travel with a mark for NULL beside them, as pandas has none.
    """
    marked, fields = [], []
    for i, k in enumerate(keys):
        kind, value = rows.schema[k].dataType, F.col(k)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = F.when(value == 0, F.lit(0).cast(kind)).otherwise(value)
        if isinstance(kind, (T.IntegralType, T.FractionalType, T.BooleanType)):
            value = F.coalesce(value, F.lit(0).cast(kind))
        marked += [value.alias(f"k{i}"), F.col(k).isNull().alias(f"m{i}")]
        fields += [T.StructField(f"k{i}", kind), T.StructField(f"m{i}", T.BooleanType())]
    named = rows.select(*marked, "_event_time", "us", *values)
    names = [f.name for f in fields]
    bucket = F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int") if names else F.lit(0)
    schema = T.StructType([*fields, *T.StructType.fromDDL(result).fields])
    found = (
        named.withColumn("_bucket", bucket)
        .groupBy("_bucket")
        .transformWithStateInPandas(processor(names), schema, "Append", "EventTime")
    )
    return found.select(
        *[F.when(~F.col(f"m{i}"), F.col(f"k{i}")).alias(k) for i, k in enumerate(keys)],
        *schema.names[len(names):],
    )


def stream_counter_delta(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    counters: Sequence[str],
    watermark: str,
    expire_after_ms: int | None = None,
    beat: str | None = None,
) -> DataFrame:
    """Delta of every snapshot to the last known values of its key, in time order.

    The rows of :func:`~fleetlens.operators.counters.successive_delta`, each as soon as the
    watermark has passed its time.  Rows that arrive behind the watermark are left out, as are rows
    without a time and heartbeats (where ``beat`` is true).  With ``expire_after_ms`` a key that is
    silent for longer starts anew: its state goes, and its next snapshot emits nothing.
    """
    keys, counters = list(keys), list(counters)
    n = range(len(counters))
    kind = stream.schema[ts].dataType
    rows = _timed(stream, ts, watermark).filter(_with_time(beat))
    values = []
    for i, c in enumerate(counters):
        value = F.col(c).cast("bigint")
        values += [F.coalesce(value, F.lit(0)).alias(f"c{i}"), value.isNull().alias(f"n{i}")]
    fields = ["_previous_us long", "_us long", *(f"c{i} long" for i in n), "reset boolean"]
    deltas = _in_buckets(
        rows, keys, values, lambda by: _Deltas(by, len(counters), expire_after_ms), ", ".join(fields)
    )
    return deltas.select(
        *keys,
        from_micros("_previous_us", kind).alias(f"previous_{ts}"),
        from_micros("_us", kind).alias(ts),
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(counters)],
        "reset",
    )


class _Alerts(InTimeOrder):
    def __init__(self, keys: Sequence[str], cooldown_us: int) -> None:
        super().__init__(keys, ["value"])
        self._cooldown_us = cooldown_us

    def release(self, rows: pd.DataFrame, carried: pd.DataFrame | None):
        before = 0 if carried is None else len(carried)
        names = pd.concat([carried[self._by], rows[self._by]], ignore_index=True) if before else rows[self._by]
        codes = self._codes(names)
        # The time of the last alert by key.
        last = np.full(codes.max() + 1, np.iinfo(np.int64).min)
        if before:
            last[codes[:before]] = carried["us"].to_numpy(np.int64)
        code, us = codes[before:], rows["us"].to_numpy(np.int64)
        value = rows["value"].to_numpy(np.float64)
        order = np.lexsort((us, code))
        code, us, value = code[order], us[order], value[order]
        first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(us) != 0)))
        code, us, value = code[first], us[first], np.maximum.reduceat(value, first)
        ends = np.flatnonzero(np.append(np.diff(code) != 0, True)) + 1
        alerts = []
        for begin, end in zip(np.append(0, ends[:-1]), ends):
            of = code[begin]
            never = last[of] == np.iinfo(np.int64).min
            start = last[of] if never else last[of] + self._cooldown_us
            chosen = begin + greedy_thinning(us[begin:end], self._cooldown_us, start)
            if len(chosen):
                last[of] = us[chosen[-1]]
                alerts.append(chosen)
        chosen = np.concatenate(alerts) if alerts else np.zeros(0, np.int64)
        out = rows[self._by].iloc[order[first[chosen]]].reset_index(drop=True)
        out["_us"], out["_metric"] = us[chosen], value[chosen]
        some = np.flatnonzero(last != np.iinfo(np.int64).min)
        _, place = np.unique(codes, return_index=True)
        known = names.iloc[place[some]].reset_index(drop=True)
        known["us"] = last[some]
        return out, known


def stream_threshold_alert(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    metric: str,
    op: str = ">",
    threshold: float = 50.0,
    cooldown_s: float = 10.0,
    *,
    watermark: str,
    beat: str | None = None,
) -> DataFrame:
    """Rows whose metric crosses the threshold, at most one per key and cooldown (event time).

    The rows of :func:`~fleetlens.operators.alerts.threshold_alerts`, each as soon as the watermark
    has passed its time.  Late rows and heartbeats raise none.
    """
    keys = list(keys)
    # Rows below the threshold never leave the JVM, but they move the watermark.
    crosses = _OPERATORS[op](F.col(metric), F.lit(threshold))
    crossing = _timed(stream, ts, watermark).filter(_with_time(beat, crosses))
    value = F.col(metric).cast("double").alias("value")
    alerts = _in_buckets(
        crossing, keys, [value], lambda by: _Alerts(by, int(cooldown_s * 1_000_000)),
        "_us long, _metric double",
    )
    return alerts.select(
        *keys,
        from_micros("_us", stream.schema[ts].dataType).alias(ts),
        F.col("_metric").alias(metric),
        F.lit(op).alias("op"),
        F.lit(float(threshold)).alias("threshold"),
    )


def stream_events(
    stream: DataFrame,
    xml_col: str = "target_data",
    keep: Sequence[str] = (),
    event_name: str | None = None,
    logins: bool = False,
) -> DataFrame:
    """Arriving event documents as rows: stateless, the batch functions unchanged."""
    if logins:
        return login_failures(stream, xml_col, keep)
    return shred_events(stream, xml_col, keep, event_name)

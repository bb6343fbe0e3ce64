"""The events table replayed as a stream that ends (``availableNow``)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.alerts import threshold_alerts
from fleetlens.operators.distributed import ensure_checkpoint_dir
from fleetlens.streaming import (
    stream_counter_delta,
    stream_events,
    stream_threshold_alert,
    use_ordered_state,
)
from proxies.base import ORACLES, cents, load, query
from proxies.counters import gappy_cents
from proxies.events import event_element


#: The events arrive in so many files, dealt by id: every file spans the whole time.
FILES = 6
#: Longer than the table, so no row is late; the heartbeat lies as far behind the last row.
PATIENCE = "400 days"


def stream(spark, sf: str, table: str) -> DataFrame:
    # A pattern, because a stream source cannot be a single file; it also matches a folder.
    schema = load(spark, sf, table).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    return source.parquet(f"{sf}/{table}.parquet*")


def arrivals(spark, sf: str) -> DataFrame:
    """The events as a stream of files out of time order, one per trigger, and a heartbeat."""
    use_ordered_state(spark)
    events = load(spark, sf, "events")
    folder = f"{ensure_checkpoint_dir(spark)}/arrivals-{uuid4().hex}"
    rows = events.withColumn("beat", F.lit(False))
    rows.repartition(FILES, "event_id").write.parquet(folder)
    last = events.agg(F.max("ts").alias("ts")).select(
        *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns if c != "ts"],
        (F.col("ts") + F.expr(f"INTERVAL {PATIENCE}") + F.expr("INTERVAL 1 DAY")).alias("ts"),
        F.lit(True).alias("beat"),
    )
    last.select(rows.columns).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    return source.parquet(folder)


def replay(spark, result: DataFrame) -> DataFrame:
    """Run a stream to its end into a fresh folder that all executors reach; its rows."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    running = (
        result.writeStream.format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{root}/rows")


def delta_stream(spark, sf, c) -> DataFrame:
    rows = arrivals(spark, sf).select("user_id", "event_type", "ts", "beat", c.alias("c"), "event_id")
    return stream_counter_delta(
        rows, ["user_id", "event_type"], "ts", ["c", "event_id"], watermark=PATIENCE, beat="beat"
    )


@query("stream_counter_delta", ORACLES["successive_delta"])
def counter_delta(spark, sf):
    return replay(spark, delta_stream(spark, sf, cents("value")))


@query("stream_counter_delta_gaps", ORACLES["successive_delta_gaps"])
def counter_delta_gaps(spark, sf):
    return replay(spark, delta_stream(spark, sf, gappy_cents()))


_ALERTS_SQL = """WITH RECURSIVE q AS (SELECT event_type, ts, value FROM events WHERE value > 25),
    a AS (SELECT event_type, min(ts) AS ts FROM q GROUP BY event_type
      UNION ALL SELECT a.event_type, min(q.ts) FROM a JOIN q
        ON q.event_type = a.event_type AND q.ts >= a.ts + INTERVAL 6 HOUR GROUP BY a.event_type)
    SELECT event_type, ts, value, '>' AS op, CAST(25 AS DOUBLE) AS threshold FROM a JOIN q USING (event_type, ts)"""


@query("stream_threshold_alert", _ALERTS_SQL)
def threshold_alert(spark, sf):
    rows = arrivals(spark, sf).select("event_type", "ts", "value", "beat")
    alerts = stream_threshold_alert(
        rows, ["event_type"], "ts", "value", ">", 25.0, 6 * 3600, watermark=PATIENCE, beat="beat"
    )
    return replay(spark, alerts)


@query("threshold_alerts", _ALERTS_SQL)
def threshold_alerts_batch(spark, sf):
    return threshold_alerts(
        load(spark, sf, "events"), ["event_type"], "ts", "value", ">", 25.0, cooldown_s=6 * 3600
    )


@query("stream_events", ORACLES["shred_events_by_name"])
def events_stream(spark, sf):
    documents = stream(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("<RingBufferTarget>"), event_element(), F.lit("</RingBufferTarget>"))
        .alias("target_data"),
    )
    return replay(spark, stream_events(documents, keep=["event_id"], event_name="error"))

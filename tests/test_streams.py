import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import as_set
from pyspark.sql import functions as F

from fleetlens.operators.alerts import greedy_thinning, slice_steps, threshold_alerts
from fleetlens.operators.counters import successive_delta
from fleetlens.operators.distributed import ensure_checkpoint_dir
from fleetlens.streaming import stream_counter_delta, stream_threshold_alert, use_ordered_state

DDL = "k string, ts timestamp, c bigint"
START = datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a stream that reads the given batches one file at a time, in this order."""
    use_ordered_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def go(batches, build, ddl=DDL):
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
        source = (spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        result = build(source)
        query = (result.writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{tmp_path}/out")

    yield go
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def texts(df):
    return sorted(map(str, df.collect()))


BEAT = "k string, ts {kind}, c bigint, d bigint, beat boolean"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_any_file_order_equals_batch(spark, run, kind):
    """Files out of time order, one per trigger, with gaps, ties and falls; a heartbeat ends them."""
    rng = random.Random(1)
    data = [
        (rng.choice(["a", "b", None]), START + timedelta(minutes=rng.randrange(50)),
         rng.choice([None, rng.randrange(2**60), 5]), rng.choice([None, i]), False)
        for i in range(80)
    ]
    data += [("a", None, 1, 1, False)]
    rng.shuffle(data)
    beat = [(None, START + timedelta(days=3), None, None, True)]
    batches = [data[i:i + 20] for i in range(0, len(data), 20)] + [beat]
    ddl = BEAT.format(kind=kind)
    got = run(batches, lambda s: stream_counter_delta(s, ["k"], "ts", ["c", "d"], "1 day", beat="beat"), ddl)
    want = successive_delta(spark.createDataFrame(data, ddl), ["k"], "ts", ["c", "d"], "hour")
    assert texts(got) == texts(want)
    assert got.filter("reset").count() and got.filter("c is null and not reset").count()


def test_rows_leave_with_the_watermark_and_late_ones_are_dropped(run):
    t = [START + timedelta(minutes=i) for i in range(60)]
    batches = [[("a", t[0], 1), ("a", t[3], 5)], [("a", t[2], 3)], [("a", t[20], 9)], [("a", t[1], 2)],
               [("a", t[40], 8)]]
    got = run(batches, lambda s: stream_counter_delta(s, ["k"], "ts", ["c"], "5 minutes"))
    # The third file moves the watermark to minute 15, so the row of minute 1 comes too late; minute
    # 20 leaves behind the last file, whose own row is still waiting.
    assert as_set(got.select("previous_ts", "ts", "c")) == [(t[0], t[2], 2), (t[2], t[3], 2), (t[3], t[20], 4)]


def test_silent_keys_expire(run):
    hour = [START + timedelta(hours=i) for i in range(12)]
    batches = [[("a", hour[0], 1)], [("b", hour[1], 1)], [("b", hour[5], 2)], [("b", hour[6], 3)], [("a", hour[7], 9)],
               [("a", hour[8], 10)], [("c", hour[11], 1)]]
    got = run(batches, lambda s: stream_counter_delta(s, ["k"], "ts", ["c"], "1 minute", expire_after_ms=7_200_000))
    # Both keys were silent for longer than two hours once.
    assert as_set(got.select("k", "ts", "c")) == [("a", hour[8], 1), ("b", hour[6], 1)]


def brute_alerts(data, threshold, cooldown):
    last, out = {}, []
    for key, ts, value in sorted(data, key=lambda r: (r[1], -r[2])):
        if value > threshold and (key not in last or ts - last[key] >= cooldown):
            out.append((key, ts, float(value)))
            last[key] = ts
    return sorted(out)


def test_alerts_of_any_file_order_equal_batch(spark, run):
    rng = random.Random(4)
    data = [(rng.choice("ab"), START + timedelta(seconds=rng.randrange(400)), rng.randrange(100)) for i in range(120)]
    batches = [[(*r, None, False) for r in data[i:i + 30]] for i in range(0, 120, 30)]
    batches.append([(None, START + timedelta(days=3), None, None, True)])
    got = run(
        batches,
        lambda s: stream_threshold_alert(s, ["k"], "ts", "c", ">", 50, 10, watermark="1 day", beat="beat"),
        BEAT.format(kind="timestamp"),
    )
    want = threshold_alerts(spark.createDataFrame(data, DDL), ["k"], "ts", "c", ">", 50, 10, slice_s=30)
    assert texts(got) == texts(want)
    assert as_set(got.select("k", "ts", "c")) == brute_alerts(data, 50, timedelta(seconds=10))


@pytest.mark.parametrize("slice_s", [10, 17, 60, 100_000])
def test_alerts_over_slices_of_any_length(spark, slice_s):
    """Dense stretches, single rows, empty slices and ties, in runs of many slices."""
    rng = random.Random(slice_s)
    data = []
    for key, span, n in (("dense", 300, 900), ("sparse", 20_000, 200), ("tie", 12, 40)):
        data += [(key, START + timedelta(seconds=rng.randrange(span)), rng.randrange(45, 100)) for _ in range(n)]
    df = spark.createDataFrame(data, DDL)
    got = threshold_alerts(df, ["k"], "ts", "c", ">", 50, 10, slice_s=slice_s)
    assert as_set(got.select("k", "ts", "c")) == brute_alerts(data, 50, timedelta(seconds=10))


def test_alerts_of_one_hot_key(spark):
    """A row per 10 ms for some hours, in slices of minutes: the chain passes through all of them."""
    us = (np.arange(400_000, dtype=np.int64) * 10_007) % (3 * 3600 * 10**6)
    df = spark.range(len(us)).select(
        F.lit("k").alias("k"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.col("id") * 10_007, F.lit(3 * 3600 * 10**6))).alias("ts"),
        F.lit(60.0).alias("v"),
    )
    got = threshold_alerts(df, ["k"], "ts", "v", cooldown_s=47, slice_s=600)
    want = np.unique(us)[greedy_thinning(np.unique(us), 47_000_000, 0)]
    found = got.select(F.unix_micros("ts") - 1_700_000_000_000_000).orderBy("ts").collect()
    assert [r[0] for r in found] == want.tolist()


def test_steps_of_a_slice_say_when_it_is_left():
    rng = np.random.default_rng(2)
    for _ in range(200):
        cooldown, begin = int(rng.integers(1, 60)), 1000
        us = np.unique(rng.integers(begin, begin + 100, int(rng.integers(1, 60))))
        hi, free = slice_steps(us, cooldown, begin, begin + 100)
        for entry in range(begin - 5, begin + cooldown):
            chosen = greedy_thinning(us, cooldown, entry)
            left = us[chosen[-1]] + cooldown if len(chosen) else begin + 100
            assert free[np.searchsorted(hi, entry)] == left


def test_no_cooldown_null_keys_and_unknown_values(spark):
    data = [(None, START, 60), (None, START, 70), ("a", None, 90), ("a", START, None), ("a", START, 10)]
    df = spark.createDataFrame(data, DDL)
    assert as_set(threshold_alerts(df, ["k"], "ts", "c", cooldown_s=0).select("k", "c")) == [(None, 70.0)]
    assert as_set(threshold_alerts(df, ["k"], "ts", "c").select("k", "c")) == [(None, 70.0)]
    below = threshold_alerts(df, ["k"], "ts", "c", "<", 50.0)
    assert as_set(below.select("k", "c", "op")) == [("a", 10.0, "<")]


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or named in folder


def test_many_keys_share_a_state(spark, run):
    """Keys of several kinds, NULLs among them, in few states; far more keys than states would be slow."""
    rng = random.Random(9)
    keys = [(rng.choice([None, 0, 2**60 + i, -i]), rng.choice(["a", "", None]), rng.choice([0.5, None, 0.0]))
            for i in range(3000)]
    ddl = "k bigint, s string, f double, ts timestamp, c bigint, beat boolean"
    data = [(*rng.choice(keys), START + timedelta(seconds=rng.randrange(4000)), i, False) for i in range(9000)]
    batches = [data[:4000], data[4000:], [(None, None, None, START + timedelta(days=3), None, True)]]
    by = ["k", "s", "f"]
    states = []

    def build(source):
        out = stream_counter_delta(source, by, "ts", ["c"], "1 day", beat="beat")
        states.append(out._jdf.queryExecution().analyzed().toString())
        return out

    got = run(batches, build, ddl)
    want = successive_delta(spark.createDataFrame(data, ddl), by, "ts", ["c"], "hour")
    assert texts(got) == texts(want)
    assert "TransformWithStateInPySpark" in states[0] and "_bucket" in states[0]

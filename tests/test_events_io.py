import json
from datetime import datetime

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from fleetlens.operators import events, history, needles, synth, workload
from fleetlens.sources import readers, sinks
from fleetlens.sources.schemas import SCHEMAS, schema_of

DOC = (
    '<RingBufferTarget truncated="0"><event name="xml_deadlock_report" package="p" '
    'timestamp="2024-03-31T00:30:00.123Z"><data name="xml_report"><value><deadlock>\n<a x="1"/>'
    "</deadlock></value></data></event><event name=\"other\" timestamp=\"2024-01-01T00:00:00Z\"/></RingBufferTarget>"
)


def test_shred_keeps_the_whole_element(rows):
    df = rows("id int, target_data string", (1, DOC), (2, None), (3, "<RingBufferTarget/>"))
    got = events.shred_events(df, keep=["id"]).collect()
    assert [(r.id, r.event_name) for r in got] == [(1, "xml_deadlock_report"), (1, "other")]
    assert got[0].event_timestamp == datetime(2024, 3, 31, 0, 30, 0, 123000)
    assert got[0].event.startswith("<event name=") and "<a x=\"1\"/>" in got[0].event
    assert events.deadlock_events(df).count() == 1


def test_login_failure_fields(rows):
    doc = ('<RingBufferTarget><event name="error_reported" timestamp="2024-01-01T00:00:00Z">'
           '<data name="message"><value>Login &amp; failed</value></data>'
           '<action name="database_id"><value>oops</value></action></event></RingBufferTarget>')
    row = events.login_failures(rows("target_data string", (doc,))).first()
    assert (row.event_message, row.client_app_name, row.database_id) == ("Login & failed", None, None)


def test_deadlocks_in_local_time(rows):
    event = '<event name="xml_deadlock_report" timestamp="2024-{}T12:00:00Z"/>'
    files = rows("file_name string, object_name string, event_data string",
                 ("C:\\System_Health_1.xel", "XML_DEADLOCK_REPORT", event.format("07-01")),
                 ("C:\\system_health_2.xel", "xml_deadlock_report", event.format("01-01")),
                 ("C:\\other.xel", "xml_deadlock_report", event.format("02-01")))
    got = events.recent_deadlocks(files, "C:\\system_health*.xel", "Europe/Zurich").collect()
    assert [r.local_time.hour for r in got] == [14, 13]
    assert events.recent_deadlocks(files, n=1).count() == 1


def test_last_good_check_ignores_bad_values(rows):
    eav = rows("database_name string, field string, value string",
               ("a", "dbi_dbccLastKnownGood", "2024-01-02 03:04:05.000"), ("a", "dbi_dbccLastKnownGood", "junk"),
               ("b", "dbi_dbccLastKnownGood", None), ("c", "dbi_x", "2024-01-01"))
    assert {r.database_name: r.last_good_check for r in events.last_good_check(eav).collect()} == {
        "a": datetime(2024, 1, 2, 3, 4, 5), "b": None}


def test_search(rows):
    tables = {"dbo.t]x": rows("a string, n int, b string", ("in LUXEMBOURG", 1, "x" * 4000 + "luxembourg"), ("no", 2, None)),
              "dbo.numbers": rows("n int", (1,))}
    got = as_set(events.search_all_strings(tables, "Luxembourg"))
    assert [(c, len(v)) for c, v in got] == [("[dbo].[t]]x].[a]", 13), ("[dbo].[t]]x].[b]", 3630)]
    with pytest.raises(ValueError):
        events.search_all_strings({"n": rows("n int", (1,))}, "x")


def test_command_outcomes(rows):
    day = datetime(2024, 1, 1)
    log = rows("start_time timestamp, end_time timestamp, error_number int", (day, day, None),
               (day, datetime(2024, 1, 2, 1), 0), (day, datetime(2024, 1, 1, 0, 1), 1222), (day, None, None))
    got = history.command_outcome(log).collect()
    assert [(r.outcome, r.duration) for r in got] == [
        ("Not Executed", "00:00:00"), ("Succeeded", "1.01:00:00"), ("Failed", "00:01:00"), (None, None)]
    policy = [(r.severity, r.return_code) for r in history.severity_policy(log).collect()]
    assert policy == [(None, 0), (None, 0), (16, 1222), (None, 0)]
    assert history.severity_policy(log, 10).collect()[2].return_code == 0


def test_tuning_without_force_details(rows):
    details = json.dumps({"planForceDetails": {"queryId": 1, "regressedPlanExecutionCount": 3,
                          "recommendedPlanExecutionCount": 1, "regressedPlanCpuTimeAverage": 2e6,
                          "recommendedPlanCpuTimeAverage": 1e6}})
    df = rows("reason string, score int, details string", ("r", 1, details), ("r", 1, "{}"), ("r", 1, "junk"))
    got = workload.tuning_recommendations(df).collect()
    assert [(r.query_id, r.script, r.estimated_gain) for r in got] == [(1, None, 4.0)]


def test_ntile_closed_form(spark):
    from pyspark.sql import Window

    for rows_, tiles in ((10, 3), (26, 26), (7, 10), (2048, 26)):
        df = spark.range(1, rows_ + 1).select(
            "id", synth.ntile_of(F.col("id"), rows_, F.lit(tiles)).alias("got"),
            F.ntile(tiles).over(Window.orderBy("id")).alias("want"))
        assert df.filter("got <> want").count() == 0


def test_series_ids_have_no_gaps(rows):
    products = rows("id bigint, price bigint", *[(i, 10) for i in range(1, 40)])
    series = synth.sparse_series(products, "id", "price", days=50, seed=3)
    n, low, high, distinct = series.agg(F.count("*"), F.min("transaction_id"), F.max("transaction_id"),
                                        F.count_distinct("transaction_id")).first()
    assert (low, high, distinct) == (1, n, n)


def test_failing_source_is_skipped(spark, rows):
    def broken():
        raise OSError("unreachable")

    df, failures = readers.union_sources({"s1": lambda: rows("n int", (1,)), "s2": broken,
                                          "s3": lambda: rows("n int, m int", (2, 3))})
    assert as_set(df.select("server", "n")) == [("s1", 1), ("s3", 2)]
    assert failures == {"s2": "unreachable"}
    with pytest.raises(ValueError):
        readers.union_sources({"s2": broken})


def test_versions(spark, rows, tmp_path):
    root = f"file:{tmp_path}/log"
    day = datetime(2024, 1, 31)
    assert sinks.latest_version(spark, root) is None
    log = rows("ts timestamp, n int", (datetime(2023, 12, 1), 1), (datetime(2024, 1, 30), 2))
    first = sinks.replace_version(log, root)
    kept = history.purge_older_than(spark.read.parquet(first), "ts", F.lit(day))
    sinks.replace_version(kept, root)
    assert as_set(spark.read.parquet(sinks.latest_version(spark, root)).select("n")) == [(2,)]


def test_sinks(spark, rows, tmp_path):
    df = rows("id int, stmt string", (2, "b\nb"), (1, "a"), (3, None))
    sinks.write_statements(df, "stmt", f"{tmp_path}/sql", ["id"])
    assert as_set(spark.read.text(f"{tmp_path}/sql")) == [("a",), ("b b",)]
    sinks.append_capture(df, f"{tmp_path}/cap", ["id"])
    sinks.append_capture(df, f"{tmp_path}/cap", ["id"])
    assert spark.read.parquet(f"{tmp_path}/cap").count() == 6
    sinks.replace_partitions(df.filter("id = 1"), f"{tmp_path}/cap", ["id"])
    assert spark.read.parquet(f"{tmp_path}/cap").groupBy("id").count().filter("id = 1").first()["count"] == 1


def test_event_files_by_wildcard(spark, tmp_path):
    for name in ("system_health_1", "other_1"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"object_name": "o", "event_data": name}))
    got = readers.read_event_files(spark, f"{tmp_path}/system_health*.json")
    assert as_set(got.select("file_name", "event_data")) == [("system_health_1.json", "system_health_1")]


def test_schemas_parse_and_read(spark, tmp_path):
    for table in SCHEMAS:
        assert schema_of(table).fieldNames()[:2] == ["server", "snapshot_ts"]
    spark.createDataFrame([], schema_of("wait_stats")).write.parquet(f"{tmp_path}/wait_stats")
    assert readers.read_landed(spark, str(tmp_path), "wait_stats").count() == 0
    assert readers.stream_landed(spark, str(tmp_path), "wait_stats").isStreaming


def test_event_files_keep_broken_elements(spark, tmp_path):
    """Whatever breaks an element, the others of its file come through, in batch and as a stream."""
    good = '<event name="{}" timestamp="2024-01-01T00:00:0{}Z"><data name="m"><value>{}</value></data></event>'
    texts = {
        "a.xml": "<R>" + good.format("one", 1, "x &amp; y") + '<event name="bad"><data name="m"><value>oops</data></event>'
        + good.format("two", 2, "z") + '<event name="self" timestamp="zz"/>\n<!-- none -->' + good.format("three", 3, "") + "</R>",
        "b.xml": "<?xml version='1.0'?><R>" + good.format("cdata", 4, "<![CDATA[a</event>b]]>") + good.format("four", 5, "é") + "</R><R>"
        + good.format("next", 6, "1") + '</R>\n<R><event name="cut"><data name="m">',
        "c.xml": "<R></R>",
    }
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)

    def found(df):
        items = events.item_value("data", "m").alias("m")
        return sorted((r.file_name, r.event_name or "", r.m, r.malformed is not None) for r in df.select(
            "file_name", "event_name", items, "malformed").collect())

    batch = readers.read_event_xml(spark, str(tmp_path / "in"))
    names = [(f, n, bad) for f, n, _, bad in found(batch)]
    assert [n for f, n, bad in names if not bad] == ["one", "self", "three", "two", "four", "next"]
    assert {f for f, _, bad in names if bad} == {"a.xml", "b.xml"}
    assert sum("cut" in r.malformed for r in batch.filter("malformed is not null").collect()) == 1
    assert ("a.xml", "one", "x & y", False) in found(batch)
    stream = readers.stream_event_xml(spark, str(tmp_path / "in"), 1)
    run = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert found(spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))) == found(batch)


def test_needle_index_opens_few_files_and_loses_no_row(spark, tmp_path):
    """Fifty files of a table, needles in none, one and all of them, of any case and with wildcards."""
    words = [f"word{i * 7919 % 1000:03d}" for i in range(1000)]
    data = [(i, i // 20, " ".join(words[(i * 13 + j) % 1000] for j in range(30)), None if i % 3 else f"Größe {i}") for i in range(1000)]
    data[417] = (417, 20, "here stands a NeedLe]x, alone", "x")
    df = spark.createDataFrame(data, "id int, file int, body string, note string")
    df.repartitionByRange(50, "file").write.parquet(str(tmp_path / "t"))
    tables = {"dbo.t": spark.read.parquet(str(tmp_path / "t")), "dbo.none": spark.range(3)}
    needles.needle_index(tables).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    every = index.select("file_path").distinct().count()
    for needle in ("needle", "NEEDLE]X", "größe 9", "GRÖSSE", "word007", "stands%alone", "nee[d]le", "zzz", "x", "%", "ds a"):
        got = needles.search_with_index(spark, tables, index, needle)
        assert as_set(got) == as_set(events.search_all_strings(tables, needle)), needle
    assert every >= 40
    opened = needles.files_to_open(index, "Needle")
    assert 0 < opened.select("file_path").distinct().count() < every / 10
    assert needles.files_to_open(index, "qqqq").count() == 0
    assert needles.files_to_open(index, "a%b") is None

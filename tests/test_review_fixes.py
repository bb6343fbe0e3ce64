"""Cases that an earlier version answered wrongly."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import events, selection, synth, waits, workload


def test_a_null_in_the_list_excludes_nothing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "wait_type string")
    listed = spark.createDataFrame([("a",), (None,)], "n string")
    for names in (["a", None], listed):
        assert [r[0] for r in waits.exclude_benign(df, names=names).collect()] == ["b"]


def test_rules_match_alike_whatever_their_number(spark):
    names = ["stra\u017fse", "\u0131stanbul", "straße", "Über", "plain", "other"]
    items = spark.createDataFrame([(n,) for n in names], "database_name string")
    few = ["STRASSE", "ISTANBUL", "ÜBER", "PLAIN", "-other"]
    found = []
    for extra in (0, 600):
        text = ",".join([*few, *[f"unrelated{i}" for i in range(extra)]])
        lists = spark.createDataFrame([(text,)], "list string")
        rules = selection.parse_rules(selection.split_list(lists, "list"))
        chosen = selection.select_items(items, rules, ["database_name"])
        found.append({r.database_name for r in chosen.where("selected").collect()})
    assert found[0] == found[1] == {"stra\u017fse", "\u0131stanbul", "Über", "plain"}


XML = (
    "<RingBufferTarget><event name='error' timestamp='2024-01-01T00:00:00Z' note='a > b'>"
    "<data name='x'><value><![CDATA[ </event> ]]></value></data><!-- </event> --></event>"
    "<event name='error' timestamp='never'/><event name='error'><data name='y'/></event></RingBufferTarget>"
)


def test_events_with_cdata_and_bad_times(spark):
    df = spark.createDataFrame([(XML,)], "target_data string")
    rows = events.shred_events(df, event_name="error").collect()
    assert [r.event.endswith(("</event>", "/>")) for r in rows] == [True] * 3
    assert "<!-- </event> -->" in rows[0].event
    assert [r.event_timestamp is None for r in rows] == [False, True, True]
    assert len(events.login_failures(df).collect()) == 3


def test_newest_reports_of_each_key_in_any_session_zone(spark):
    rows = [
        (s, "f", "xml_deadlock_report", f"<event timestamp='{t}'/>")
        for s in "ab"
        for t in ("2024-03-10T02:30:00Z", "2024-03-10T01:30:00Z", "bad")
    ]
    files = spark.createDataFrame(rows, "server string, file_name string, object_name string, event_data string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = events.recent_deadlocks(files, n=1, keys=["server"]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted((r.server, str(r.local_time)) for r in found) == [
        ("a", "2024-03-10 02:30:00"),
        ("b", "2024-03-10 02:30:00"),
    ]


def test_statements_of_each_server(spark):
    stats = spark.createDataFrame(
        [(s, h, h, h, h, i) for i, (s, h) in enumerate([("a", 1), ("a", 2), ("a", 3), ("b", 4)])],
        "server string, query_hash long, query_plan_hash long, sql_handle long, plan_handle long, max_worker_time long",
    ).withColumns(
        {
            c: F.lit(1)
            for c in (
                "creation_time last_execution_time execution_count total_worker_time max_grant_kb "
                "max_used_grant_kb total_spills statement_start_offset statement_end_offset"
            ).split()
        }
    )
    texts = stats.select("server", "sql_handle", F.lit("select 1").alias("text"))
    plans = stats.select("server", "plan_handle", F.lit("plan").alias("query_plan"))
    missing = stats.select("server", "query_hash", "query_plan_hash", F.col("sql_handle").alias("last_sql_handle"))
    found = workload.top_cpu_missing_index(stats, texts, plans, missing, n=2, keys=["server"]).collect()
    assert sorted((r.server, r.sql_handle) for r in found) == [("a", 2), ("a", 3), ("b", 4)]


def test_a_backslash_is_searched_as_it_stands(spark):
    df = spark.createDataFrame([("c:\\LOG\\a",), ("c:log",), ("50%",)], "s string")
    assert events.search_all_strings({"dbo.t": df}, "C:\\log").count() == 1
    assert events.search_all_strings({"dbo.t": df}, "[5-9]0[%]").count() == 1


def test_copies_that_would_share_ids_are_refused(spark):
    df = spark.range(1, 2001).withColumn("name", F.lit("x"))
    with pytest.raises(ValueError, match="collide"):
        synth.scale_up(df, "id")
    assert synth.scale_up(df, "id", n=3, step=2000).select("id").distinct().count() == 6000

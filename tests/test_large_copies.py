"""What broke on tables 6 and 60 times as large."""

from conftest import as_set
from pyspark.sql import functions as F

from fleetlens.operators import backup, compliance, events, needles, selection, synth, workload
from proxies import QUERIES


def _permissions(spark, rows, objects, logins):
    return compliance.permission_statements(
        rows("principal_id int, name string, type string, sid binary, default_schema_name string, "
             "authentication_type int, login_name string, is_fixed_role boolean",
             (5, "ann", "U", b"\2", None, 1, "ann", False), (6, "bob", "U", b"\3", None, 1, "bob", False)),
        rows("role_principal_id int, member_principal_id int", (6, 5)),
        rows("class int, class_desc string, major_id int, minor_id int, grantee_principal_id int, state string, "
             "state_desc string, permission_name string",
             (1, "OBJECT", 100, 0, 5, "G", "GRANT", "SELECT")),
        rows("object_id int, column_id int, name string", (100, 2, "c")),
        objects,
        rows("user_type_id int, name string, schema_id int", (77, "T", 9)),
        rows("schema_id int, name string", (9, "app")),
        rows("name string, sid binary", *logins),
        rows("database_name string", ("d",)),
    )


def test_objects_made_from_few_rows_are_not_broadcast(spark, rows):
    # Small in the files, large once multiplied: Spark's estimate sees the former only.
    many = spark.range(10).select("id", F.explode(F.sequence(F.lit(0), F.lit(19_999))).alias("n"))
    objects = many.select(
        (F.col("id") * 20_000 + F.col("n")).cast("int").alias("object_id"),
        F.lit("t").alias("name"), F.lit("dbo").alias("schema_name"), F.lit("U ").alias("type"))
    out = _permissions(spark, rows, objects, [("ann", b"\2")])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "major_id" in line]
    # Objects by shuffle; the few columns and types may be broadcast.
    assert ["SortMergeJoin" in line for line in joins].count(True) == 1 and len(joins) == 3
    assert out.filter("result_order = 7.2").count() == 1


def test_a_user_meets_many_logins_of_its_name_once(spark, rows):
    logins = [("ANN", b"\2"), ("Ann", b"\4"), ("ann", b"\5"), ("bob", b"\3"), ("BOB", b"\3"), ("bob", None)]
    out = _permissions(spark, rows, rows("object_id int, name string, schema_name string, type string",
                                         (100, "t", "dbo", "U ")), logins)
    assert as_set(out.filter("result_order = 4.1").select("statement")) == [
        ("ALTER USER [ann] WITH LOGIN = [ann]",)]


def test_copies_of_parts_with_far_keys_are_all_made(spark, rows, tmp_path):
    rows("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
         (1, "a", "b", "t", 1, 2.0), (1_000_001, "c", "d", "t", 1, 2.0)).write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["scale_up"](spark, str(tmp_path))
    assert (out.count(), out.select("p_partkey").distinct().count()) == (100, 51)
    assert as_set(out.filter("p_partkey = 3000001").select("p_name")) == [("a3000000",), ("c2000000",)]


def test_progress_far_beyond_the_size(rows):
    seeding = rows(
        "local_database_name string, remote_machine_name string, role_desc string, "
        "transfer_rate_bytes_per_second bigint, transferred_size_bytes bigint, database_size_bytes bigint, "
        "start_time_utc timestamp, estimate_time_complete_utc timestamp, total_disk_io_wait_time_ms bigint, "
        "total_network_wait_time_ms bigint, is_compression_enabled boolean",
        ("d", "m", "Source", 1, 900_000_000_000, 86_000_000, None, None, 0, 0, False))
    assert float(workload.seeding_progress(seeding).first().percent_done) == 1046511.63


def test_days_of_few_ids_are_made_in_many_tasks(spark):
    ids = spark.range(1, 5001, numPartitions=1)
    dates = synth.sparse_dates(ids, "id", synth.largest_divisor(F.col("id")))
    assert dates.rdd.getNumPartitions() >= 10
    long = synth.sparse_dates(spark.range(1, 31), "id", F.col("id"), days=17)
    # More tiles than days: the tiles behind the last day are empty.
    assert as_set(long.filter("id = 30").select(F.datediff("transaction_date", F.lit("2005-01-01")))) == [
        (d,) for d in range(0, 17, 2)]


def test_series_are_grouped_by_id_without_a_shuffle(spark):
    ids = spark.range(1, 3001).select("id", F.lit(10.0).alias("price"), F.lit("x").alias("label"))
    series = synth.sparse_series(ids, "id", "price", seed=3, keep=["label"])
    assert series.rdd.getNumPartitions() >= 3 and series.filter("label = 'x'").count() == series.count()
    plan = series.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_targets_are_found_once_and_then_ordered(spark):
    plan = QUERIES["index_maintenance_plan"](spark, "/root/testdata/sf0.001")
    files = plan.inputFiles()
    assert any("/targets-" in f for f in files)
    # The part table feeds nothing but the targets.
    assert not any("part.parquet" in f for f in files)


def test_a_fixed_template_is_not_tidied_row_by_row(spark, rows):
    df = rows("a string, b string", ("x", "y"), (None, "y"), ("x", None), (None, None), ("{b}", "_$"))
    tokens = {"A": F.col("a"), "B": F.col("b"), "C": F.lit(None).cast("string")}
    asof = F.lit("2024-01-08").cast("timestamp")
    for template in ("{C}_{A}${B}_{Year}", "{A}/{C}{B}/{Month}"):
        got, want = (backup.render_template(df, t, tokens, asof, "f", directory="/" in template)
                     for t in (template, F.lit(template)))
        assert as_set(got.fillna("-")) == as_set(want.fillna("-"))
        assert "lambdafunction" not in got._jdf.queryExecution().analyzed().toString()


def test_equal_rules_of_a_long_list_meet_an_item_once(spark):
    """400 items under 40,000 rules of four texts: pairs by the different rules, not by their copies."""
    items = spark.range(400).select(F.lit("s").alias("server"), F.concat(F.lit("item "), F.col("id")).alias("name"))
    texts = F.array(*[F.lit(t) for t in ("ITE%7", "item%", "%", "item 9")])
    rules = spark.range(40_000).select(
        F.lit("s").alias("server"), F.get(texts, (F.col("id") % 4).cast("int")).alias("name"),
        (F.col("id") + 5).cast("int").alias("start_position"), (F.col("id") % 40 != 0).alias("selected"))
    hits = []
    original = selection.pattern_hits
    selection.pattern_hits = lambda *a: hits.append(original(*a)) or hits[-1]
    try:
        got = selection.select_items(items, rules, ["name"], keys=["server"])
    finally:
        selection.pattern_hits = original
    # The texts' one excluding rule, "ITE%7", and three including ones besides those of "item 9".
    assert hits[0].count() == 2 * 40 + 400 + 400
    seen = {r.name: (r.selected, r.start_position) for r in got.collect()}
    assert seen["item 7"] == (False, 6) and seen["item 9"] == (True, 6) and len(seen) == 400
    assert {p for _, p in seen.values()} == {6}


def test_an_index_of_texts_sends_filters_and_not_pieces(spark, tmp_path):
    odd = ["Stra\u00dfe \u1e9e", "\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2", "\U00010400a\U00010428", "ab", "", None, "one\0two\nthree",
           "x" * 2_000_000 + "Last"]
    data = [(t, f"{'abc'[i % 3]}bc") for i, t in enumerate(odd)]
    spark.createDataFrame(data, "text string, note string").repartition(3).write.parquet(f"{tmp_path}/t")
    tables = {"dbo.t": spark.read.parquet(f"{tmp_path}/t")}
    made = needles.needle_index(tables)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    made.write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.groupBy("table_name", "file_path", "column_name", "part").count().filter("count > 1").isEmpty()
    for needle in ("STRA\u00dfE \u00df", "\u03c3\u038a\u03a3\u03a5", "\U00010428A\U00010428", "TWO\nT", "xlast", "two%one", "BBC", "babc"):
        got = needles.search_with_index(spark, tables, index, needle)
        assert as_set(got) == as_set(events.search_all_strings(tables, needle)), needle

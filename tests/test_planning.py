from datetime import datetime

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from fleetlens.operators import backup, compliance, maintenance
from fleetlens.operators.maintenance import REBUILD_OFFLINE, REBUILD_ONLINE, REORGANIZE

NOW = datetime(2024, 5, 1, 12)

TARGET = dict(
    object_id=1, index_id=1, index_name="ix", index_type=1, schema_name="dbo", object_name="t",
    object_type="U", allow_page_locks=True, is_image_text=False, is_new_lob=False, is_filestream=False,
    is_columnstore=False, is_computed=False, is_timestamp=False, is_memory_optimized=False,
    on_read_only_filegroup=False, resumable_index_operation=False, statistics_id=1, statistics_name="st",
    no_recompute=False, is_incremental=False, partition_number=1, partition_count=1,
    fragmentation_level=50.0, page_count=5000, row_count=100, modification_counter=0,
)
TARGET_DDL = (
    "object_id int, index_id int, index_name string, index_type int, schema_name string, "
    "object_name string, object_type string, allow_page_locks boolean, is_image_text boolean, "
    "is_new_lob boolean, is_filestream boolean, is_columnstore boolean, is_computed boolean, "
    "is_timestamp boolean, is_memory_optimized boolean, on_read_only_filegroup boolean, "
    "resumable_index_operation boolean, statistics_id int, statistics_name string, no_recompute boolean, "
    "is_incremental boolean, partition_number int, partition_count int, fragmentation_level double, "
    "page_count bigint, row_count bigint, modification_counter bigint"
)


@pytest.fixture
def target(spark):
    def make(**changes):
        return spark.createDataFrame([tuple({**TARGET, **changes}.values())], TARGET_DDL)

    return make


def _allowed(df, **options):
    return set(maintenance.allowed_actions(df, **options).first().allowed_actions)


def test_allowed_actions(target):
    everything = {REORGANIZE, REBUILD_ONLINE, REBUILD_OFFLINE}
    assert _allowed(target()) == everything
    assert _allowed(target(allow_page_locks=False)) == {REBUILD_ONLINE, REBUILD_OFFLINE}
    assert _allowed(target(allow_page_locks=False, index_type=5)) == {REORGANIZE, REBUILD_OFFLINE}
    assert _allowed(target(), edition=2) == {REORGANIZE, REBUILD_OFFLINE}
    assert _allowed(target(is_image_text=True)) == {REORGANIZE, REBUILD_OFFLINE}
    assert _allowed(target(is_new_lob=True), version=10) == {REORGANIZE, REBUILD_OFFLINE}
    assert _allowed(target(is_new_lob=True, is_filestream=True)) == {REORGANIZE, REBUILD_OFFLINE}
    assert _allowed(target(is_columnstore=True)) == {REORGANIZE, REBUILD_OFFLINE}
    assert _allowed(target(partition_count=4), version=11) == {REORGANIZE, REBUILD_OFFLINE}
    assert _allowed(target(on_read_only_filegroup=True)) == set()
    assert _allowed(target(is_memory_optimized=True)) == set()
    assert _allowed(target(is_memory_optimized=None)) == everything
    assert _allowed(target(index_type=7)) == set()
    assert _allowed(target(index_id=None)) == set()


def _action(df, **options):
    return maintenance.choose_action(maintenance.allowed_actions(df), **options).first()


def test_choose_action(target):
    assert _action(target()).action == REBUILD_ONLINE
    medium = _action(target(fragmentation_level=5.0))
    assert (medium.fragmentation_group, medium.action) == ("Medium", REORGANIZE)
    assert _action(target(fragmentation_level=4.9)).action is None
    assert _action(target(fragmentation_level=30.0)).fragmentation_group == "High"
    unknown = _action(target(fragmentation_level=None))
    assert (unknown.fragmentation_group, unknown.action) == (None, None)
    assert _action(target(page_count=999)).action is None
    assert _action(target(page_count=None), min_pages=0).action == REBUILD_ONLINE
    assert _action(target(), max_pages=4999).action is None
    assert _action(target(page_count=1, resumable_index_operation=True)).action == REBUILD_ONLINE
    same = {g: [REBUILD_OFFLINE] for g in ("Low", "Medium", "High")}
    assert _action(target(fragmentation_level=None), preferences=same).action == REBUILD_OFFLINE
    assert _action(target(), preferences={}).action is None


def _updates(df, **options):
    planned = maintenance.choose_action(maintenance.allowed_actions(df))
    return maintenance.stats_update_decision(planned, **options).first().update_statistics


def test_statistics_decision(target):
    still = dict(fragmentation_level=1.0)
    assert _updates(target(**still)) is True
    assert _updates(target()) is False, "rebuilt statistics are fresh"
    assert _updates(target(**still), only_modified=True) is False
    assert _updates(target(modification_counter=1, **still), only_modified=True) is True
    assert _updates(target(modification_counter=5, **still), level=5) is True
    assert _updates(target(modification_counter=4, **still), level=5) is False
    assert _updates(target(modification_counter=317, row_count=100, **still), level=5000) is True
    assert _updates(target(modification_counter=316, row_count=100, **still), level=5000) is False
    assert _updates(target(modification_counter=1, row_count=0, **still), level=5) is True
    assert _updates(target(**still), mode="COLUMNS") is False
    assert _updates(target(index_id=None, index_type=None, **still), mode="COLUMNS") is True
    assert _updates(target(index_type=5, **still)) is False
    assert _updates(target(statistics_id=None, **still)) is False
    assert _updates(target(partition_count=3, partition_number=3)) is True
    assert _updates(target(partition_count=3, partition_number=2)) is False
    assert _updates(target(partition_count=3, partition_number=2, is_incremental=True), per_partition=True) is True
    assert _updates(target(**still), mode=None) is False


def _command(df, **options):
    acted = maintenance.choose_action(maintenance.allowed_actions(df))
    return maintenance.index_command(acted, **options).first().index_command


def test_index_commands(target):
    assert _command(target()) == (
        "ALTER INDEX [ix] ON [dbo].[t] REBUILD WITH (SORT_IN_TEMPDB = OFF, ONLINE = ON, RESUMABLE = OFF)")
    assert _command(target(fragmentation_level=10.0, partition_count=2), lock_timeout_s=3) == (
        "SET LOCK_TIMEOUT 3000; ALTER INDEX [ix] ON [dbo].[t] REORGANIZE PARTITION = 1 "
        "WITH (LOB_COMPACTION = ON)")
    assert _command(target(resumable_index_operation=True), max_dop=8) == (
        "ALTER INDEX [ix] ON [dbo].[t] RESUME WITH (MAXDOP = 8)")
    assert "MAXDOP = 1," in _command(target(allow_page_locks=False), max_dop=8)
    assert _command(target(fragmentation_level=1.0)) is None


def test_backup_type_and_eligibility(rows):
    ddl = ("database_name string, recovery_model string, last_log_backup_lsn int, differential_base_lsn int, "
           "allocated_extent_page_count int, modified_extent_page_count int, base_is_snapshot boolean")
    dbs = rows(ddl, ("master", "FULL", None, 1, 10, 1, None), ("no_chain", "FULL", None, 1, 10, 1, None),
               ("no_base", "FULL", None, None, 10, 1, None), ("simple", "SIMPLE", None, 1, 10, 1, None),
               ("changed", "FULL", None, 1, 10, 5, None), ("snap", "FULL", None, 1, 10, 1, True),
               ("chain", "FULL", 9, 1, 10, 9, None), ("empty", "FULL", None, 1, 0, 0, None))

    def types(**options):
        df = backup.backup_type(dbs, "LOG", **options)
        return {r.database_name: r.backup_type for r in df.collect()}

    assert set(types().values()) == {"LOG"}
    assert types(change=True, modification_level=50) == {
        "master": "LOG", "no_chain": "DIFF", "no_base": "FULL", "simple": "LOG", "changed": "FULL",
        "snap": "FULL", "chain": "LOG", "empty": "DIFF"}


def test_unknown_role_in_a_group_is_not_eligible(rows):
    ddl = ("database_name string, backup_type string, state_desc string, user_access_desc string, "
           "is_accessible boolean, is_in_standby boolean, is_read_only boolean, recovery_model string, "
           "availability_group string, role string, is_preferred_replica boolean, log_shipping_role string, "
           "differential_base_lsn int, last_log_backup_lsn int, log_since_last_log_backup_mb double, "
           "log_backup_time timestamp")
    base = ("FULL", "ONLINE", "MULTI_USER", True, False, False, "FULL")
    dbs = rows(ddl, ("alone", *base, None, None, None, None, 1, 1, None, None),
               ("primary", *base, "AG", "PRIMARY", True, None, 1, 1, None, None),
               ("unknown", *base, "AG", None, None, None, 1, 1, None, None),
               ("no_standby_info", "FULL", "ONLINE", "MULTI_USER", True, None, False, "FULL", None, None, None,
                None, 1, 1, None, None))
    got = backup.backup_eligible(dbs, F.lit(NOW)).filter("eligible")
    assert as_set(got.select("database_name")) == [("alone",), ("primary",)]


def test_stripes_cover_each_file_once(spark):
    plan = spark.range(1, 13).select("id", (F.col("id") * 4).cast("int").alias("number_of_files"))
    files = backup.stripe_files(plan, ["a", "b", "c", "d"])
    per = files.groupBy("id", "directory_path").count().collect()
    assert all(r["count"] == r["id"] for r in per) and len(per) == 48
    assert files.groupBy("id", "file_number").count().filter("count > 1").count() == 0
    for number in (1, 5):
        uneven = plan.limit(1).withColumn("number_of_files", F.lit(number))
        with pytest.raises(Exception, match="cannot be spread evenly"):
            backup.stripe_files(uneven, ["a", "b"]).collect()


def test_long_names_are_cut(spark):
    df = spark.range(1).select(
        F.lit("{DatabaseName}_FULL_{FileNumber}.bak").alias("f"), F.lit("d" * 200).alias("n"))
    got = df.select(backup.cap_database_name(F.col("f"), F.lit(100), F.col("n"), F.lit(12))).first()[0]
    assert got == "d" * (259 - 100 - len("_FULL_01.bak") - 3) + "..._FULL_{FileNumber}.bak"
    short = df.select(backup.cap_database_name(F.col("f"), F.lit(10), F.col("n"), F.lit(1))).first()[0]
    assert short == "d" * 200 + "_FULL_{FileNumber}.bak"


def test_no_cleanup_without_hours_or_base(rows):
    dbs = rows("database_name string, backup_type string, differential_base_lsn int",
               ("a", "LOG", 5), ("b", "LOG", 5), ("c", "FULL", 5))
    backups = rows("database_name string, type string, backup_start_date timestamp, last_lsn int, is_damaged boolean",
                   ("a", "D", datetime(2024, 4, 1), 1, False), ("a", "D", datetime(2024, 4, 9), 1, True),
                   ("a", "L", datetime(2024, 4, 2), 4, False), ("a", "L", datetime(2024, 4, 3), 5, False))
    got = backup.cleanup_cutoff(dbs, backups, 24, F.lit(NOW).cast("timestamp"))
    assert {r.database_name: r.cleanup_date for r in got.collect()} == {
        "a": datetime(2024, 4, 2), "b": None, "c": datetime(2024, 4, 30, 12)}
    never = backup.cleanup_cutoff(dbs, backups, None, F.lit(NOW).cast("timestamp"))
    assert never.filter("cleanup_date is not null").count() == 0


def test_missing_on_replica_without_keys(rows):
    databases = rows("database_name string, recovery_model string, status string",
                     ("a", "FULL", "Normal"), ("b", "Simple", "Normal"), ("c", "Full", "Offline"))
    replicas = rows("name string, role string, seeding_mode string, version_major int",
                    ("p", "Primary", "Automatic", 15), ("s1", "Secondary", "Automatic", 15),
                    ("s2", "Secondary", "Automatic", 12))
    present = rows("replica string, database_name string", ("s1", "a"))
    assert as_set(compliance.missing_on_replica(databases, replicas, present)) == [
        ("a", "s2", "BACKUP_RESTORE", False), ("b", "s1", "AUTOMATIC_SEEDING", True),
        ("b", "s2", "BACKUP_RESTORE", True)]


def test_expectations(rows):
    facts = rows("resource string, name string, value string", ("h", "PowerPlan", "High Performance"),
                 ("h", "BlockSize", "65536"), ("h", "IndexingEnabled", "False"), ("h", "LogCount", None),
                 ("h", "Unruled", "1"))
    got = compliance.config_expectations(facts).collect()
    assert {r["name"]: r.passed for r in got} == {
        "PowerPlan": True, "BlockSize": True, "IndexingEnabled": True, "LogCount": False}


def test_permission_statement_texts(rows):
    principals = rows(
        "principal_id int, name string, type string, sid binary, default_schema_name string, "
        "authentication_type int, login_name string, is_fixed_role boolean",
        (1, "dbo", "S", b"\1", "dbo", 1, "sa", False), (5, "ann", "U", b"\2", None, 1, "D\\ann", False),
        (6, "bob", "S", b"\xab", "app", 0, None, False), (7, "readers", "R", None, None, None, None, False))
    out = compliance.permission_statements(
        principals,
        rows("role_principal_id int, member_principal_id int", (7, 5), (7, 1)),
        rows("class int, class_desc string, major_id int, minor_id int, grantee_principal_id int, state string, "
             "state_desc string, permission_name string", (1, "OBJECT", 100, 2, 5, "W", "GRANT_WITH_GRANT_OPTION",
             "SELECT"), (0, "DATABASE", 0, 0, 6, "D", "DENY", "CONNECT"), (3, "SCHEMA", 9, 0, 7, "G", "GRANT", "ALTER")),
        rows("object_id int, column_id int, name string", (100, 2, "c")),
        rows("object_id int, name string, schema_name string, type string", (100, "t", "dbo", "U ")),
        rows("user_type_id int, name string, schema_id int", (77, "T", 9)),
        rows("schema_id int, name string", (9, "app")),
        rows("name string, sid binary", ("ANN", b"\3")),
        rows("database_name string", ("D]B",)),
    )
    by_order = {}
    for r in out.filter("statement not like '--%' and statement <> ''").collect():
        by_order.setdefault(float(r.result_order), []).append(r.statement)
    assert by_order[1.1] == ["USE [D]]B]"]
    assert by_order[3.1][0].endswith("CREATE USER  [ann] FOR LOGIN [D\\ann] WITH DEFAULT_SCHEMA = [dbo] END; ")
    assert by_order[3.1][1].endswith("[bob] WITHOUT LOGIN WITH DEFAULT_SCHEMA = [app] , SID = 0xAB  END; ")
    assert by_order[4.1] == ["ALTER USER [ann] WITH LOGIN = [ann]"]
    assert by_order[5.1] == ["IF DATABASE_PRINCIPAL_ID('readers') IS NULL CREATE ROLE [readers]"]
    assert by_order[5.2] == ["IF DATABASE_PRINCIPAL_ID('ann') IS NOT NULL EXEC sp_addrolemember "
                             "@rolename = 'readers', @membername = 'ann'"]
    assert by_order[7.2] == ["IF DATABASE_PRINCIPAL_ID('ann') IS NOT NULL GRANT SELECT ON [dbo].[t]([c]) "
                             "TO [ann] WITH GRANT OPTION"]
    assert by_order[10.1] == ["IF DATABASE_PRINCIPAL_ID('bob') IS NOT NULL DENY CONNECT TO [bob]"]
    assert by_order[12.1] == ["IF DATABASE_PRINCIPAL_ID('readers') IS NOT NULL GRANT ALTER ON SCHEMA::[app] "
                              "TO [readers]"]

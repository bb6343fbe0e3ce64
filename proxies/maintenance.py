"""Index maintenance: a catalog derived from line items, and parts as index targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import maintenance
from fleetlens.operators.selection import as_rules
from fleetlens.plans import index_maintenance_plan
from proxies.base import derive, load, query, sql_columns

# --- catalog --------------------------------------------------------------------------------------
# One object per part; one index per (part, line number), whose type is the line number; one
# partition per (part, line number, return flag).

INDEXES = {
    "object_id": "l_partkey",
    "index_id": "l_linenumber",
    "name": "concat('IX_', CAST(l_linenumber AS STRING))",
    "type": "l_linenumber",
    "allow_page_locks": "count(*) < 8",
    "is_disabled": "min(l_suppkey) = 0",
    "is_hypothetical": "max(l_tax) < 0.01",
    "data_space_id": "CAST(min(l_suppkey) % 25 AS INT)",
}
PARTITIONS = {
    "object_id": "l_partkey",
    "index_id": "l_linenumber",
    "partition_number": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END",
    "partition_id": "l_partkey * 100 + l_linenumber * 10 + "
    "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END",
}
STATS = {
    "object_id": "l_partkey",
    "stats_id": "CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE l_linenumber + 3 END",
    "name": "concat('ST_', CAST(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE l_linenumber + 3 END "
    "AS STRING))",
    "no_recompute": "max(l_tax) > 0.07",
    "is_incremental": "min(l_tax) < 0.01",
}
OBJECTS = {
    "object_id": "p_partkey",
    "schema_id": "p_size",
    "name": "p_name",
    "type": "CASE p_type WHEN 'SMALL' THEN 'V ' WHEN 'PROMO' THEN 'S ' ELSE 'U ' END",
    "is_ms_shipped": "p_brand = 'Brand#5'",
}
TABLES = {
    "object_id": "p_partkey",
    "is_memory_optimized": "p_brand = 'Brand#7'",
    "lob_data_space_id": "p_size",
}
# Two columns per part.
COLUMN_1 = {
    "object_id": "p_partkey",
    "column_id": "1",
    "system_type_id": "CASE WHEN p_size < 10 THEN 167 WHEN p_size < 20 THEN 189 WHEN p_size < 30 THEN 240 "
    "ELSE 56 END",
    "user_type_id": "CASE WHEN p_size < 10 THEN 167 WHEN p_size < 20 THEN 189 WHEN p_size < 30 THEN 130 "
    "ELSE 56 END",
    "max_length": "CASE WHEN p_size > 5 THEN -1 ELSE 50 END",
    "is_filestream": "p_brand = 'Brand#3'",
    "is_computed": "p_brand = 'Brand#4'",
}
COLUMN_2 = {
    "object_id": "p_partkey",
    "column_id": "2",
    "system_type_id": "CASE p_type WHEN 'ECONOMY' THEN 34 WHEN 'MEDIUM' THEN 241 ELSE 56 END",
    "user_type_id": "CASE p_type WHEN 'ECONOMY' THEN 34 WHEN 'MEDIUM' THEN 241 ELSE 56 END",
    "max_length": "8",
    "is_filestream": "FALSE",
    "is_computed": "p_size > 48",
}
INDEX_COLUMNS = {
    "object_id": "l_partkey",
    "index_id": "l_linenumber",
    "column_id": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END",
    "key_ordinal": "CASE WHEN l_linenumber < 5 THEN 1 ELSE 0 END",
    "partition_ordinal": "0",
}
FILEGROUPS = {"data_space_id": "n_nationkey", "is_read_only": "n_regionkey = 0"}
SPACES = {
    "partition_scheme_id": "n_nationkey - 5",
    "destination_id": "n_regionkey",
    "data_space_id": "n_nationkey",
}
PAUSED = {
    "object_id": "l_partkey",
    "index_id": "l_linenumber",
    "partition_number": "CASE WHEN l_linestatus = 'O' THEN 2 END",
    "state_desc": "CASE WHEN l_discount > 0.05 THEN 'PAUSED' ELSE 'RUNNING' END",
}
# Ids of a few column types, as (system id, user id, name, assembly type).
TYPES = [
    (34, 34, "image", False),
    (56, 56, "int", False),
    (167, 167, "varchar", False),
    (189, 189, "timestamp", False),
    (240, 130, "geography", True),
    (241, 241, "xml", False),
]


def _aggregates(columns: dict[str, str], keys: list[str]) -> list:
    return [F.expr(e).alias(n) for n, e in columns.items() if n not in keys]


def catalog(spark, sf: str) -> dict[str, DataFrame]:
    lines, part, nation = (load(spark, sf, t) for t in ("lineitem", "part", "nation"))
    by_index = lines.groupBy("l_partkey", "l_linenumber")
    indexes = by_index.agg(*_aggregates(INDEXES, ["object_id", "index_id", "name", "type"]))
    stats_id = F.expr(STATS["stats_id"])
    stats = (
        lines.groupBy("l_partkey", stats_id.alias("stats_id"))
        .agg(*_aggregates(STATS, ["object_id", "stats_id", "name"]))
        .withColumn("name", F.concat(F.lit("ST_"), F.col("stats_id").cast("string")))
        .withColumnRenamed("l_partkey", "object_id")
    )
    return {
        "indexes": indexes.select(
            F.col("l_partkey").alias("object_id"),
            F.col("l_linenumber").alias("index_id"),
            F.expr(INDEXES["name"]).alias("name"),
            F.col("l_linenumber").alias("type"),
            "allow_page_locks",
            "is_disabled",
            "is_hypothetical",
            "data_space_id",
        ),
        "partitions": derive(lines, PARTITIONS).distinct(),
        "stats": stats,
        "objects": derive(part, OBJECTS),
        "tables": derive(part, TABLES),
        "schemas": derive(nation, {"schema_id": "n_nationkey", "name": "n_name"}),
        "columns": derive(part, COLUMN_1).union(derive(part, COLUMN_2)),
        "types": spark.createDataFrame(
            TYPES, "system_type_id int, user_type_id int, name string, is_assembly_type boolean"
        ),
        "index_columns": derive(lines, INDEX_COLUMNS).distinct(),
        "filegroups": derive(nation, FILEGROUPS),
        "destination_data_spaces": derive(nation, SPACES),
        "resumable_operations": derive(
            lines.filter("l_quantity > 49").select("l_partkey", "l_linenumber", "l_linestatus",
                                                   "l_discount"), PAUSED
        ),
    }


_SQL_CATALOG = f"""
    indexes AS (SELECT {sql_columns(INDEXES)} FROM lineitem GROUP BY l_partkey, l_linenumber),
    partitions AS (SELECT DISTINCT {sql_columns(PARTITIONS)} FROM lineitem),
    stats AS (SELECT {sql_columns(STATS)} FROM lineitem GROUP BY l_partkey, {STATS['stats_id']}),
    objects AS (SELECT {sql_columns(OBJECTS)} FROM part),
    tables AS (SELECT {sql_columns(TABLES)} FROM part),
    schemas AS (SELECT n_nationkey AS schema_id, n_name AS name FROM nation),
    columns AS (SELECT {sql_columns(COLUMN_1)} FROM part UNION ALL SELECT {sql_columns(COLUMN_2)} FROM part),
    types(system_type_id, user_type_id, name, is_assembly_type) AS
      (VALUES {', '.join(f"({a}, {b}, '{n}', {x})" for a, b, n, x in TYPES)}),
    index_columns AS (SELECT DISTINCT {sql_columns(INDEX_COLUMNS)} FROM lineitem),
    filegroups AS (SELECT {sql_columns(FILEGROUPS)} FROM nation),
    spaces AS (SELECT {sql_columns(SPACES)} FROM nation),
    paused AS (SELECT {sql_columns(PAUSED)} FROM lineitem WHERE l_quantity > 49)"""

_LOB = """(t.name = 'xml' OR (t.name IN ('varchar', 'nvarchar', 'varbinary') AND c.max_length = -1)
      OR (t.is_assembly_type AND c.max_length = -1))"""
_TYPED = "(c.system_type_id = t.user_type_id OR (c.user_type_id = t.user_type_id AND t.is_assembly_type))"

_SQL_TARGETS = f"""WITH {_SQL_CATALOG},
    column_types AS (SELECT c.object_id, c.column_id,
        bool_or(c.system_type_id = t.user_type_id AND t.name IN ('image', 'text', 'ntext')) AS image,
        bool_or({_TYPED} AND {_LOB}) AS lob,
        bool_or(c.system_type_id = t.system_type_id AND t.name = 'timestamp') AS stamp
      FROM columns c, types t GROUP BY ALL),
    index_types AS (SELECT x.object_id, x.index_id, bool_or(ct.lob) AS lob, bool_or(ct.stamp) AS stamp,
        bool_or((key_ordinal > 0 OR partition_ordinal > 0) AND c.is_computed) AS computed
      FROM index_columns x JOIN columns c USING (object_id, column_id)
        JOIN column_types ct USING (object_id, column_id) GROUP BY ALL),
    object_types AS (SELECT c.object_id, bool_or(ct.image) AS image, bool_or(ct.lob) AS lob,
        bool_or(c.is_filestream) AS filestream
      FROM columns c JOIN column_types ct USING (object_id, column_id) GROUP BY ALL),
    column_stores AS (SELECT DISTINCT object_id FROM indexes WHERE type IN (5, 6)),
    counts AS (SELECT object_id, index_id, CAST(count(DISTINCT partition_number) AS INTEGER) AS n
      FROM partitions GROUP BY ALL),
    index_rows AS (
      SELECT i.object_id, i.index_id, i.name AS index_name, i.type AS index_type, i.allow_page_locks,
        i.type = 1 AND coalesce(ot.image, FALSE) AS is_image_text,
        (i.type = 1 AND coalesce(ot.lob, FALSE)) OR (i.type = 2 AND coalesce(it.lob, FALSE)) AS is_new_lob,
        i.type = 1 AND coalesce(ot.filestream, FALSE) AS is_filestream,
        i.object_id IN (FROM column_stores) AS is_columnstore,
        coalesce(it.computed, FALSE) AS is_computed, coalesce(it.stamp, FALSE) AS is_timestamp,
        EXISTS (SELECT * FROM spaces d JOIN filegroups f USING (data_space_id) WHERE f.is_read_only
            AND d.partition_scheme_id = i.data_space_id AND d.destination_id = p.partition_number)
          OR EXISTS (SELECT * FROM filegroups f WHERE f.is_read_only AND f.data_space_id = i.data_space_id)
          OR (i.type = 1 AND EXISTS (SELECT * FROM tables t JOIN filegroups f
              ON t.lob_data_space_id = f.data_space_id WHERE f.is_read_only AND t.object_id = i.object_id))
          AS on_read_only_filegroup,
        EXISTS (SELECT * FROM paused r WHERE state_desc = 'PAUSED' AND r.object_id = i.object_id
            AND r.index_id = i.index_id
            AND (r.partition_number = p.partition_number OR r.partition_number IS NULL))
          AS resumable_index_operation,
        s.stats_id AS statistics_id, s.name AS statistics_name, s.no_recompute, s.is_incremental,
        p.partition_id, p.partition_number, n AS partition_count
      FROM indexes i LEFT JOIN stats s ON i.object_id = s.object_id AND i.index_id = s.stats_id
        LEFT JOIN partitions p ON i.object_id = p.object_id AND i.index_id = p.index_id
        LEFT JOIN counts k ON i.object_id = k.object_id AND i.index_id = k.index_id
        LEFT JOIN index_types it ON i.object_id = it.object_id AND i.index_id = it.index_id
        LEFT JOIN object_types ot ON i.object_id = ot.object_id
      WHERE i.type BETWEEN 1 AND 7 AND NOT is_disabled AND NOT is_hypothetical),
    statistics_rows AS (
      SELECT object_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        stats_id, name, no_recompute, is_incremental, NULL, NULL, NULL
      FROM stats s WHERE NOT EXISTS (SELECT * FROM indexes i WHERE i.object_id = s.object_id
        AND i.index_id = s.stats_id)),
    targets AS (
      SELECT DISTINCT r.*, o.name AS object_name, rtrim(o.type) AS object_type, o.schema_id,
        c.name AS schema_name, t.is_memory_optimized
      FROM (SELECT * FROM index_rows UNION SELECT * FROM statistics_rows) r
        JOIN objects o USING (object_id) JOIN schemas c USING (schema_id)
        LEFT JOIN tables t USING (object_id)
      WHERE rtrim(o.type) IN ('U', 'V') AND NOT o.is_ms_shipped)"""


@query("index_stat_targets", f"{_SQL_TARGETS} SELECT * FROM targets")
def index_stat_targets(spark, sf):
    return maintenance.index_stat_targets(catalog(spark, sf), update_statistics="ALL")


# --- measurements ---------------------------------------------------------------------------------

PHYSICAL = {
    "object_id": "l_partkey",
    "index_id": "l_linenumber",
    "partition_number": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END",
    "alloc_unit_type_desc": "CASE WHEN l_tax > 0.07 THEN 'LOB_DATA' ELSE 'IN_ROW_DATA' END",
    "index_level": "CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END",
    "avg_fragmentation_in_percent": "round(l_discount * 1000)",
    "page_count": "CAST(l_quantity AS BIGINT) * 100",
}

_SQL_FRAGMENTATION = f"""fragmentation AS (
      SELECT object_id, index_id, partition_number, max(avg_fragmentation_in_percent) AS fragmentation_level,
        CAST(sum(page_count) AS BIGINT) AS page_count
      FROM (SELECT {sql_columns(PHYSICAL)} FROM lineitem)
      WHERE alloc_unit_type_desc = 'IN_ROW_DATA' AND index_level = 0 GROUP BY ALL)"""


def physical_stats(spark, sf: str) -> DataFrame:
    return derive(load(spark, sf, "lineitem"), PHYSICAL)


@query("fragmentation", f"WITH {_SQL_FRAGMENTATION} SELECT * FROM fragmentation")
def fragmentation(spark, sf):
    return maintenance.fragmentation(physical_stats(spark, sf))


# --- parts as measured targets --------------------------------------------------------------------

TARGETS = {
    "object_id": "p_partkey",
    "index_id": "CASE WHEN p_type <> 'SMALL' THEN p_size END",
    "index_name": "CASE WHEN p_type <> 'SMALL' THEN concat(p_name, ']x') END",
    "index_type": "CASE WHEN p_type <> 'SMALL' THEN p_size % 7 + 1 END",
    "schema_name": "p_brand",
    "object_name": "p_name",
    "object_type": "CASE WHEN p_type = 'MEDIUM' THEN 'V' ELSE 'U' END",
    "allow_page_locks": "p_brand <> 'Brand#2'",
    "is_image_text": "p_brand = 'Brand#3'",
    "is_new_lob": "p_brand = 'Brand#4'",
    "is_filestream": "p_brand = 'Brand#6'",
    "is_columnstore": "p_brand = 'Brand#8'",
    "is_computed": "p_brand = 'Brand#9'",
    "is_timestamp": "p_brand = 'Brand#10'",
    "is_memory_optimized": "CASE p_brand WHEN 'Brand#11' THEN TRUE WHEN 'Brand#12' THEN FALSE END",
    "on_read_only_filegroup": "p_brand = 'Brand#13'",
    "resumable_index_operation": "p_brand = 'Brand#14'",
    "statistics_id": "CASE WHEN p_brand <> 'Brand#15' THEN p_size END",
    "statistics_name": "CASE WHEN p_brand <> 'Brand#15' THEN concat('ST', CAST(p_size AS STRING)) END",
    "no_recompute": "p_brand = 'Brand#16'",
    "is_incremental": "p_size > 40",
    "partition_number": "CASE WHEN p_size > 10 THEN p_size % 3 + 1 END",
    "partition_count": "CASE WHEN p_size > 10 THEN CASE WHEN p_size < 20 THEN 1 ELSE 3 END END",
    "fragmentation_level": "CASE WHEN p_brand <> 'Brand#17' THEN p_size * 0.75 END",
    "page_count": "CAST(round(p_retailprice * 100) AS BIGINT) - 89900",
    "row_count": "CASE WHEN p_size = 50 THEN 0 ELSE CAST(round(p_retailprice * 100) AS BIGINT) END",
    "modification_counter": "CAST(round(p_retailprice * 10) AS BIGINT) % 4000 * (p_size % 5)",
}
# In DuckDB a decimal literal makes a decimal; the level is a double in both engines.
_SQL_COLUMNS = sql_columns(
    {**TARGETS, "fragmentation_level": "CASE WHEN p_brand <> 'Brand#17' THEN p_size * CAST(0.75 AS DOUBLE) END"}
)


def targets(spark, sf: str) -> DataFrame:
    rows = derive(load(spark, sf, "part"), TARGETS)
    return rows.withColumn("fragmentation_level", F.col("fragmentation_level").cast("double"))


_PART = "(partition_number IS NOT NULL AND NOT coalesce(partition_count = 1, FALSE))"
_GROUP = """CASE WHEN fragmentation_level >= 30 THEN 'High' WHEN fragmentation_level >= 5 THEN 'Medium'
      WHEN fragmentation_level < 5 THEN 'Low' END"""
_SQL_ACTIONS = f"""t AS (SELECT {_SQL_COLUMNS} FROM part),
    w AS (SELECT *, index_id IS NOT NULL AND NOT on_read_only_filegroup
        AND NOT coalesce(is_memory_optimized, FALSE) AS ok FROM t),
    a AS (SELECT *, ok AND index_type IN (1, 2, 3, 4, 5) AND (allow_page_locks OR index_type = 5) AS can_reorg,
        ok AND index_type IN (1, 2, 3, 4, 5) AS can_off,
        ok AND NOT is_columnstore AND (index_type = 2 OR (index_type = 1 AND NOT is_image_text
          AND (NOT is_new_lob OR NOT is_filestream))) AS can_on FROM w),
    g AS (SELECT *, CASE WHEN index_id IS NOT NULL AND NOT on_read_only_filegroup THEN {_GROUP} END
        AS fragmentation_group FROM a),
    c AS (SELECT *, CASE WHEN resumable_index_operation THEN 'INDEX_REBUILD_ONLINE'
        WHEN index_id IS NULL OR page_count < 100 THEN NULL
        WHEN fragmentation_group = 'Medium' THEN CASE WHEN can_reorg THEN 'INDEX_REORGANIZE'
          WHEN can_on THEN 'INDEX_REBUILD_ONLINE' WHEN can_off THEN 'INDEX_REBUILD_OFFLINE' END
        WHEN fragmentation_group = 'High' THEN CASE WHEN can_on THEN 'INDEX_REBUILD_ONLINE'
          WHEN can_off THEN 'INDEX_REBUILD_OFFLINE' END END AS action FROM g)"""


@query(
    "fragmentation_group",
    f"WITH t AS (SELECT {_SQL_COLUMNS} FROM part) SELECT object_id, {_GROUP} AS grp FROM t",
)
def fragmentation_groups(spark, sf):
    return targets(spark, sf).select(
        "object_id", maintenance.fragmentation_group(F.col("fragmentation_level")).alias("grp")
    )


@query(
    "allowed_actions",
    f"""WITH {_SQL_ACTIONS}
    SELECT object_id, concat_ws(',', CASE WHEN can_reorg THEN 'INDEX_REORGANIZE' END,
      CASE WHEN can_off THEN 'INDEX_REBUILD_OFFLINE' END, CASE WHEN can_on THEN 'INDEX_REBUILD_ONLINE' END)
      AS actions FROM a""",
)
def allowed_actions(spark, sf):
    return maintenance.allowed_actions(targets(spark, sf)).select(
        "object_id", F.array_join("allowed_actions", ",").alias("actions")
    )


def acted(spark, sf: str) -> DataFrame:
    return maintenance.choose_action(
        maintenance.allowed_actions(targets(spark, sf)), min_pages=100
    )


@query(
    "choose_action",
    f"WITH {_SQL_ACTIONS} SELECT object_id, fragmentation_group, action FROM c",
)
def choose_action(spark, sf):
    return acted(spark, sf).select("object_id", "fragmentation_group", "action")


_SQL_STATS = f"""{_SQL_ACTIONS},
    u AS (SELECT *, coalesce(statistics_id IS NOT NULL
        AND (index_type IN (1, 2, 3, 4, 7) OR index_id IS NULL)
        AND (CASE WHEN row_count > 0 THEN modification_counter * 100 >= 20 * row_count ELSE FALSE END
          OR (modification_counter > 0 AND CAST(modification_counter AS HUGEINT) * modification_counter
            >= CAST(row_count AS HUGEINT) * 1000))
        AND ((NOT {_PART} AND coalesce(action NOT IN ('INDEX_REBUILD_ONLINE', 'INDEX_REBUILD_OFFLINE'), TRUE))
          OR ({_PART} AND (coalesce(partition_number = partition_count, FALSE) OR is_incremental))), FALSE)
        AS update_statistics FROM c)"""


def decided(spark, sf: str) -> DataFrame:
    return maintenance.stats_update_decision(
        acted(spark, sf), "ALL", level=20, per_partition=True
    )


@query(
    "stats_update_decision",
    f"WITH {_SQL_STATS} SELECT object_id, update_statistics FROM u",
)
def stats_update_decision(spark, sf):
    return decided(spark, sf).select("object_id", "update_statistics")


def _sql_flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 'Yes' WHEN NOT {c} THEN 'No' ELSE 'N/A' END"


_KINDS = "CASE index_type " + " ".join(
    f"WHEN {c} THEN '{n}'" for c, n in maintenance.INDEX_TYPES.items()
) + " ELSE 'N/A' END"
_REBUILD = "action IN ('INDEX_REBUILD_ONLINE', 'INDEX_REBUILD_OFFLINE')"
_FRESH = "NOT resumable_index_operation"
_ROW = "index_type IN (1, 2, 3, 4)"


_INDEX_OPTIONS = {
    "sort_in_tempdb": True, "max_dop": 4, "fill_factor": 90, "pad_index": True, "resumable": True,
    "max_duration_minutes": 60, "low_priority_minutes": 5, "low_priority_abort": "self",
}
_STATISTICS_OPTIONS = {"max_dop": 2, "sample": 25}
_SQL_INDEX_OPTIONS = f"""concat_ws(', ',
        CASE WHEN {_REBUILD} AND {_ROW} AND {_FRESH} THEN 'SORT_IN_TEMPDB = ON' END,
        CASE WHEN action = 'INDEX_REBUILD_ONLINE' AND {_FRESH} THEN
          'ONLINE = ON (WAIT_AT_LOW_PRIORITY (MAX_DURATION = 5, ABORT_AFTER_WAIT = SELF))' END,
        CASE WHEN action = 'INDEX_REBUILD_OFFLINE' AND {_FRESH} THEN 'ONLINE = OFF' END,
        CASE WHEN {_REBUILD} THEN 'MAXDOP = ' || CASE WHEN action = 'INDEX_REBUILD_ONLINE'
          AND NOT allow_page_locks THEN '1' ELSE '4' END END,
        CASE WHEN {_REBUILD} AND NOT {_PART} AND {_ROW} AND {_FRESH} THEN 'FILLFACTOR = 90, PAD_INDEX = ON' END,
        CASE WHEN action = 'INDEX_REBUILD_ONLINE' AND {_FRESH} THEN CASE WHEN index_type IN (1, 2)
          AND NOT is_computed AND NOT is_timestamp THEN 'RESUMABLE = ON, MAX_DURATION = 60'
          ELSE 'RESUMABLE = OFF' END END,
        CASE WHEN action = 'INDEX_REORGANIZE' THEN 'LOB_COMPACTION = ON' END)"""
_SQL_INDEX_COMMAND = f"""CASE WHEN index_id IS NOT NULL AND action IS NOT NULL THEN
        'ALTER INDEX [' || replace(index_name, ']', ']]') || '] ON [' || schema_name || '].[' || object_name || ']'
        || CASE WHEN resumable_index_operation THEN ' RESUME' WHEN {_REBUILD} THEN ' REBUILD'
             ELSE ' REORGANIZE' END
        || CASE WHEN {_PART} AND {_FRESH} THEN ' PARTITION = ' || CAST(partition_number AS VARCHAR) ELSE '' END
        || CASE WHEN opts <> '' THEN ' WITH (' || opts || ')' ELSE '' END END"""
_SQL_TABLE_OR_VIEW = "'ObjectType: ' || CASE object_type WHEN 'U' THEN 'Table' ELSE 'View' END"
_SQL_INDEX_COMMENT = f"""CASE WHEN index_id IS NOT NULL THEN
        {_SQL_TABLE_OR_VIEW} || ', IndexType: ' || {_KINDS}
        || ', ImageText: ' || {_sql_flag('is_image_text')} || ', NewLOB: ' || {_sql_flag('is_new_lob')}
        || ', FileStream: ' || {_sql_flag('is_filestream')} || ', ColumnStore: ' || {_sql_flag('is_columnstore')}
        || ', Computed: ' || {_sql_flag('is_computed')} || ', Timestamp: ' || {_sql_flag('is_timestamp')}
        || ', AllowPageLocks: ' || {_sql_flag('allow_page_locks')}
        || ', PageCount: ' || coalesce(CAST(page_count AS VARCHAR), 'N/A')
        || ', Fragmentation: ' || coalesce(CAST(fragmentation_level AS VARCHAR), 'N/A') END"""
_SQL_STATISTICS_OPTIONS = """concat_ws(', ', 'MAXDOP = 2', CASE WHEN NOT is_incremental THEN 'SAMPLE 25 PERCENT' END,
        CASE WHEN is_incremental THEN 'RESAMPLE' END, CASE WHEN no_recompute THEN 'NORECOMPUTE' END)"""
_SQL_STATISTICS_COMMAND = """CASE WHEN statistics_id IS NOT NULL AND update_statistics THEN
        'UPDATE STATISTICS [' || schema_name || '].[' || object_name || '] [' || statistics_name || '] WITH '
        || stat_opts || CASE WHEN is_incremental AND partition_number IS NOT NULL THEN
          ' ON PARTITIONS(' || CAST(partition_number AS VARCHAR) || ')' ELSE '' END END"""
_SQL_STATISTICS_COMMENT = f"""CASE WHEN statistics_id IS NOT NULL THEN
        {_SQL_TABLE_OR_VIEW}
        || ', IndexType: ' || CASE WHEN index_id IS NOT NULL THEN 'Index, IndexType: ' || {_KINDS}
             ELSE 'Column' END
        || ', Incremental: ' || CASE WHEN is_incremental THEN 'Y' ELSE 'N' END
        || ', RowCount: ' || coalesce(CAST(row_count AS VARCHAR), 'N/A')
        || ', ModificationCounter: ' || coalesce(CAST(modification_counter AS VARCHAR), 'N/A') END"""


def _sql_note(known: str, **elements: str) -> str:
    inner = " || ".join(
        f"coalesce('<{n}>' || CAST({c} AS VARCHAR) || '</{n}>', '')" for n, c in elements.items()
    )
    anything = " OR ".join(f"{c} IS NOT NULL" for c in elements.values())
    return f"""CASE WHEN {known} IS NOT NULL AND ({anything}) THEN '<ExtendedInfo>' || {inner}
      || '</ExtendedInfo>' END"""


_SQL_INDEX_INFO = _sql_note("index_id", PageCount="page_count", Fragmentation="fragmentation_level")
_SQL_STATISTICS_INFO = _sql_note(
    "statistics_id", RowCount="row_count", ModificationCounter="modification_counter"
)


@query(
    "index_command",
    f"""WITH {_SQL_ACTIONS}, o AS (SELECT *, {_SQL_INDEX_OPTIONS} AS opts FROM c)
    SELECT object_id, {_SQL_INDEX_COMMAND} AS index_command, {_SQL_INDEX_COMMENT} AS index_comment FROM o""",
)
def index_command(spark, sf):
    commanded = maintenance.index_command(acted(spark, sf), **_INDEX_OPTIONS)
    return commanded.select("object_id", "index_command", "index_comment")


@query(
    "statistics_command",
    f"""WITH {_SQL_STATS}, o AS (SELECT *, {_SQL_STATISTICS_OPTIONS} AS stat_opts FROM u)
    SELECT object_id, {_SQL_STATISTICS_COMMAND} AS statistics_command,
      {_SQL_STATISTICS_COMMENT} AS statistics_comment FROM o""",
)
def statistics_command(spark, sf):
    return maintenance.statistics_command(
        decided(spark, sf), version=15.0, per_partition=True, **_STATISTICS_OPTIONS
    ).select("object_id", "statistics_command", "statistics_comment")


@query(
    "extended_info",
    f"""WITH t AS (SELECT {_SQL_COLUMNS} FROM part)
    SELECT object_id, {_SQL_INDEX_INFO} AS index_info, {_SQL_STATISTICS_INFO} AS statistics_info FROM t""",
)
def extended_info(spark, sf):
    return maintenance.extended_info(targets(spark, sf)).select(
        "object_id", "index_info", "statistics_info"
    )


# --- the whole plan -------------------------------------------------------------------------------

STATS_PROPERTIES = {
    "object_id": "l_partkey",
    "stats_id": STATS["stats_id"],
    "partition_number": "CAST(NULL AS INT)",
    "rows": "CAST(sum(l_quantity) AS BIGINT)",
    "modification_counter": "count(*) * 9",
}


#: Partitions with counters of their own in the incremental variant; the even ones are unmodified.
PARTS = 64


_DATABASE = "concat('DB', CAST(object_id % 3 AS STRING))"
#: The list of the keyed plan, and what it says in SQL.
PLAN_RULES = "DB1.%.%.IX%, DB2.algeria.%.%,-%.%.%bolt%.%"
_SQL_CHOSEN = """, picked AS (SELECT *, CASE WHEN database_name = 'DB1'
        AND coalesce(index_name, statistics_name) ILIKE 'IX%' THEN 1
        WHEN database_name = 'DB2' AND schema_name = 'ALGERIA' THEN 13 END AS start_position
      FROM (SELECT *, 'DB' || CAST(object_id % 3 AS VARCHAR) AS database_name FROM targets)
      WHERE object_name NOT ILIKE '%bolt%')"""
#: What a row of the plan says, besides its target.
_PLAN_COLUMNS = [
    "item_order", "start_position", "fragmentation_level", "page_count", "row_count",
    "modification_counter", "fragmentation_group", "action", "update_statistics", "index_command",
    "index_comment", "statistics_command", "statistics_comment", "index_info", "statistics_info",
]
_TARGET_COLUMNS = [
    "object_id", "index_id", "index_name", "index_type", "allow_page_locks", "is_image_text",
    "is_new_lob", "is_filestream", "is_columnstore", "is_computed", "is_timestamp",
    "on_read_only_filegroup", "resumable_index_operation", "statistics_id", "statistics_name",
    "no_recompute", "is_incremental", "partition_id", "partition_number", "partition_count",
    "object_name", "object_type", "schema_id", "schema_name", "is_memory_optimized",
]


def _plan_sql(counter: str, keyed: bool = False) -> str:
    chosen = _SQL_CHOSEN if keyed else ", picked AS (SELECT *, NULL AS start_position FROM targets)"
    keys = "database_name, " if keyed else ""
    within = "PARTITION BY database_name " if keyed else ""
    return f"""{_SQL_TARGETS}{chosen}, {_SQL_FRAGMENTATION},
    properties AS (SELECT {sql_columns(STATS_PROPERTIES)} FROM lineitem
      GROUP BY l_partkey, {STATS['stats_id']}),
    parts AS (SELECT object_id, stats_id, unnest(range(1, {PARTS} + 1)) AS part, modification_counter
      FROM properties),
    o AS (SELECT *, row_number() OVER ({within}ORDER BY coalesce(resumable_index_operation, FALSE) DESC,
        start_position, schema_name,
        object_name, (index_type IS NULL)::INT, index_type NULLS FIRST, index_name NULLS FIRST,
        statistics_name NULLS FIRST, partition_number NULLS FIRST, object_id) AS item_order FROM picked
      WHERE {'start_position IS NOT NULL' if keyed else 'TRUE'}),
    m AS (SELECT o.*, fragmentation_level, page_count, q.rows AS row_count, {counter} AS modification_counter,
        coalesce(o.index_id IS NOT NULL AND NOT on_read_only_filegroup
          AND NOT coalesce(is_memory_optimized, FALSE), FALSE) AS ok
      FROM o LEFT JOIN fragmentation f ON o.object_id = f.object_id AND o.index_id = f.index_id
          AND o.partition_number = f.partition_number
        LEFT JOIN properties q ON o.object_id = q.object_id AND o.statistics_id = q.stats_id
        LEFT JOIN parts p ON o.object_id = p.object_id AND o.statistics_id = p.stats_id
          AND o.partition_number = p.part),
    g AS (SELECT *, CASE WHEN index_id IS NOT NULL AND NOT on_read_only_filegroup THEN {_GROUP} END
          AS fragmentation_group,
        ok AND index_type IN (1, 2, 3, 4, 5) AND (allow_page_locks OR index_type = 5) AS can_reorg,
        ok AND index_type IN (1, 2, 3, 4, 5) AS can_off,
        ok AND NOT is_columnstore AND (index_type = 2 OR (index_type = 1 AND NOT is_image_text
          AND (NOT is_new_lob OR NOT is_filestream))) AS can_on FROM m),
    c AS (SELECT *, CASE WHEN resumable_index_operation THEN 'INDEX_REBUILD_ONLINE'
        WHEN index_id IS NULL OR page_count IS NULL OR page_count < 1000 THEN NULL
        WHEN fragmentation_group = 'Medium' THEN CASE WHEN can_reorg THEN 'INDEX_REORGANIZE'
          WHEN can_on THEN 'INDEX_REBUILD_ONLINE' WHEN can_off THEN 'INDEX_REBUILD_OFFLINE' END
        WHEN fragmentation_group = 'High' THEN CASE WHEN can_on THEN 'INDEX_REBUILD_ONLINE'
          WHEN can_off THEN 'INDEX_REBUILD_OFFLINE' END END AS action FROM g),
    u AS (SELECT *, {_SQL_INDEX_OPTIONS} AS opts, {_SQL_STATISTICS_OPTIONS} AS stat_opts,
      coalesce(statistics_id IS NOT NULL AND (index_type IN (1, 2, 3, 4, 7) OR index_id IS NULL)
        AND modification_counter > 0
        AND ((NOT {_PART} AND coalesce(action NOT IN ('INDEX_REBUILD_ONLINE', 'INDEX_REBUILD_OFFLINE'), TRUE))
          OR ({_PART} AND (coalesce(partition_number = partition_count, FALSE) OR is_incremental))), FALSE)
        AS update_statistics FROM c)
    SELECT {keys}{', '.join(_TARGET_COLUMNS)}, item_order, start_position, fragmentation_level, page_count,
      row_count, modification_counter, fragmentation_group, action, update_statistics,
      concat_ws(',', CASE WHEN can_reorg THEN 'INDEX_REORGANIZE' END,
        CASE WHEN can_off THEN 'INDEX_REBUILD_OFFLINE' END, CASE WHEN can_on THEN 'INDEX_REBUILD_ONLINE' END)
        AS actions,
      {_SQL_INDEX_COMMAND} AS index_command, {_SQL_INDEX_COMMENT} AS index_comment,
      {_SQL_STATISTICS_COMMAND} AS statistics_command, {_SQL_STATISTICS_COMMENT} AS statistics_comment,
      {_SQL_INDEX_INFO} AS index_info, {_SQL_STATISTICS_INFO} AS statistics_info
    FROM u"""


def _properties(spark, sf: str, per_partition: bool) -> DataFrame:
    stats_id = F.expr(STATS["stats_id"]).alias("stats_id")
    properties = (
        load(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("object_id"), stats_id)
        .agg(*_aggregates(STATS_PROPERTIES, ["object_id", "stats_id", "partition_number"]))
        .withColumn("partition_number", F.lit(None).cast("int"))
    )
    if not per_partition:
        return properties
    own = properties.withColumns({
        "partition_number": F.explode(F.sequence(F.lit(1), F.lit(PARTS))),
    })
    own = own.withColumn(
        "modification_counter",
        F.when(F.col("partition_number") % 2 == 1, F.col("modification_counter")).otherwise(0),
    )
    return properties.unionByName(own)


def _plan(spark, sf: str, tables, measured, properties, keys=(), rules=None) -> DataFrame:
    plan = index_maintenance_plan(
        tables, measured, properties, keys, rules, update_statistics="ALL", only_modified=True,
        index_options=_INDEX_OPTIONS, statistics_options=_STATISTICS_OPTIONS,
    )
    return plan.select(
        *keys, *_TARGET_COLUMNS, *_PLAN_COLUMNS, F.array_join("allowed_actions", ",").alias("actions")
    )


@query("index_maintenance_plan", _plan_sql("q.modification_counter"))
def maintenance_plan(spark, sf, per_partition=False):
    return _plan(
        spark, sf, catalog(spark, sf), physical_stats(spark, sf), _properties(spark, sf, per_partition)
    )


@query(
    "index_maintenance_plan_incremental",
    _plan_sql(
        "CASE WHEN is_incremental AND p.part IS NOT NULL "
        "THEN CASE WHEN p.part % 2 = 1 THEN p.modification_counter ELSE 0 END ELSE q.modification_counter END"
    ),
)
def maintenance_plan_incremental(spark, sf):
    return maintenance_plan(spark, sf, per_partition=True)


@query("index_maintenance_plan_by_rules", _plan_sql("q.modification_counter", keyed=True))
def maintenance_plan_by_rules(spark, sf):
    """Three databases, each with the objects of a third of the ids, and a selection list."""

    def placed(df: DataFrame) -> DataFrame:
        if "object_id" in df.columns:
            return df.withColumn("database_name", F.expr(_DATABASE))
        names = F.array(*[F.lit(f"DB{i}") for i in range(3)])
        return df.withColumn("database_name", F.explode(names))

    tables = {name: placed(df) for name, df in catalog(spark, sf).items()}
    return _plan(
        spark, sf, tables, placed(physical_stats(spark, sf)), placed(_properties(spark, sf, False)),
        ["database_name"], as_rules(spark, PLAN_RULES, "indexes"),
    )

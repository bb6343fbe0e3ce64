"""Space and cache reports over orders, parts and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import capacity
from proxies.base import derive, load, query, sql_columns, sql_ratio

# Orders as database files: sizes in 8 KiB pages.
FILES = {
    "db_name": "o_orderpriority",
    "file_name": "CAST(o_orderkey AS STRING)",
    "type": "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END",
    "type_desc": "CASE o_orderstatus WHEN 'O' THEN 'ROWS' WHEN 'F' THEN 'LOG' ELSE 'FILESTREAM' END",
    "size": "CAST(round(o_totalprice * 100) AS BIGINT)",
    "space_used": "CAST(round(o_totalprice * 50) AS BIGINT) + o_custkey",
    "physical_name": "concat('E:/', CAST(o_orderkey AS STRING))",
}


@query(
    "file_free_space",
    f"""WITH f AS (SELECT {sql_columns(FILES)} FROM orders)
    SELECT db_name, file_name, type_desc, {sql_ratio('size', '128', 10, 2)} AS current_size_mb,
      {sql_ratio('size - space_used', '128', 10, 2)} AS free_space_mb, physical_name
    FROM f WHERE type IN (0, 1) AND db_name <> '1-URGENT'""",
)
def file_free_space(spark, sf):
    return capacity.file_free_space(derive(load(spark, sf, "orders"), FILES), system=["1-URGENT"])


GROWTH_FILES = {
    "database_name": "p_type",
    "file_id": "p_partkey",
    "name": "concat(p_name, ' ', CAST(p_partkey AS STRING))",
    "physical_name": "concat('D:/', p_brand)",
    "type_desc": "CASE WHEN p_size = 1 THEN 'LOG' ELSE 'ROWS' END",
    "state_desc": "'ONLINE'",
    "is_percent_growth": "p_type = 'PROMO'",
    "growth": "CAST(round(p_retailprice * 10) AS BIGINT)",
    "size": "CAST(round(p_retailprice * 100) AS BIGINT)",
    "max_size": "-1",
    "data_space_id": "p_size - 1",
}


@query(
    "autogrowth_violations",
    f"""WITH f AS (SELECT {sql_columns(GROWTH_FILES)} FROM part),
    g AS (SELECT DISTINCT p_type AS database_name, p_size AS data_space_id,
            'FG' || CAST(p_size AS VARCHAR) AS name, 'ROWS_FILEGROUP' AS type_desc
          FROM part WHERE p_size <= 40)
    SELECT f.database_name, file_id, f.name AS logical_name, physical_name, f.type_desc, state_desc,
      is_percent_growth, growth, growth // 128 AS growth_mb, size // 128 AS total_size_mb, max_size,
      CASE WHEN f.data_space_id = 0 THEN 'Log' ELSE g.name END AS filegroup_name,
      CASE WHEN f.data_space_id = 0 THEN 'Log' ELSE g.type_desc END AS filegroup_type,
      f.data_space_id AS f_space_id, g.data_space_id AS fg_space_id,
      'ALTER DATABASE [' || f.database_name || '] MODIFY FILE ( NAME = N''' || f.name
        || ''', SIZE = 65536KB , FILEGROWTH = 65536KB )' AS remediation,
      '- Database file autogrowth settings on database ' || f.database_name || ' - instance SRV1'
        AS message
    FROM f LEFT JOIN g USING (database_name, data_space_id)
    WHERE (growth // 128) % 2 <> 0 OR is_percent_growth""",
)
def autogrowth_violations(spark, sf):
    part = load(spark, sf, "part")
    groups = (
        part.filter("p_size <= 40")
        .select(
            F.col("p_type").alias("database_name"),
            F.col("p_size").alias("data_space_id"),
            F.concat(F.lit("FG"), F.col("p_size").cast("string")).alias("name"),
            F.lit("ROWS_FILEGROUP").alias("type_desc"),
        )
        .distinct()
    )
    return capacity.autogrowth_violations(derive(part, GROWTH_FILES), groups, server=F.lit("SRV1"))


TRACE = {
    "database_id": "user_id",
    "database_name": "concat('DB', CAST(user_id AS STRING))",
    "file_name": "concat('Customer#', lpad(CAST(user_id AS STRING), 9, '0'))",
    "event_class": "CASE event_type WHEN 'click' THEN 92 WHEN 'error' THEN 93 WHEN 'view' THEN 94 END",
    "integer_data": "CAST(round(value * 100) AS BIGINT)",
    "start_time": "ts",
    "duration": "CAST(round(value * 100) AS BIGINT) * 12345",
}
TRACE_FILES = {
    "database_id": "c_custkey",
    "name": "c_name",
    "physical_name": "concat('F:/', c_name)",
    "type": "c_nationkey % 5",
    "growth": "CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 8192 + c_nationkey END",
    "is_percent_growth": "c_mktsegment = 'BUILDING'",
    "size": "CAST(abs(round(c_acctbal * 100)) AS BIGINT)",
    "max_size": "CASE WHEN c_acctbal < 5000 THEN -1 ELSE 268435456 + c_nationkey END",
}


def _sql_mb(pages: str) -> str:
    """Pages as megabytes text with two decimals."""
    return f"CAST(CAST({sql_ratio(pages, '128', 19, 2)} AS DECIMAL(19, 2)) AS VARCHAR)"


@query(
    "autogrow_history",
    f"""WITH t AS (SELECT {sql_columns(TRACE)} FROM events),
    f AS (SELECT {sql_columns(TRACE_FILES)} FROM customer)
    SELECT t.database_name, physical_name AS db_file_name,
      CASE f.type WHEN 0 THEN 'Row' WHEN 1 THEN 'Log' WHEN 2 THEN 'FILESTREAM' WHEN 4 THEN 'Full-text'
        END AS file_type,
      CASE event_class WHEN 92 THEN 'Data File Auto Grow' ELSE 'Log File Auto Grow' END AS event_name,
      {sql_ratio('integer_data', '128', 19, 2)} AS auto_grow_size_mb, start_time,
      {sql_ratio('duration', '1000000', 19, 2)} AS event_duration_s,
      CASE WHEN is_percent_growth THEN CAST(growth AS VARCHAR) || '%'
        ELSE {_sql_mb('growth')} || 'MB' END AS auto_grow_setting,
      {sql_ratio('size', '128', 19, 2)} AS file_size_mb,
      CASE WHEN max_size = -1 THEN 'Unlimited' ELSE {_sql_mb('max_size')} END AS max_file_size
    FROM t JOIN f ON t.database_id = f.database_id AND t.file_name = f.name
    WHERE event_class IN (92, 93)""",
)
def autogrow_history(spark, sf):
    names = spark.createDataFrame(
        [(92, "Data File Auto Grow"), (93, "Log File Auto Grow"), (94, "Data File Auto Shrink")],
        "trace_event_id int, name string",
    )
    return capacity.autogrow_history(
        derive(load(spark, sf, "events"), TRACE), names, derive(load(spark, sf, "customer"), TRACE_FILES)
    )


@query(
    "buffer_pool_by_db",
    """WITH p AS (SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'O') AS d,
        count(*) FILTER (WHERE l_linestatus <> 'O') AS c FROM lineitem GROUP BY l_suppkey)
    SELECT s_name AS database_name, d AS dirty_page_count, c AS clean_page_count,
      d * 8 // 1024 AS dirty_page_mb, c * 8 // 1024 AS clean_page_mb
    FROM p LEFT JOIN supplier ON l_suppkey = s_suppkey""",
)
def buffer_pool_by_db(spark, sf):
    pages = load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("database_id"), (F.col("l_linestatus") == "O").alias("is_modified")
    )
    dbs = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("database_id"), F.col("s_name").alias("name")
    )
    return capacity.buffer_pool_by_db(pages, dbs)


def part_objects(spark, sf: str) -> dict[str, DataFrame]:
    """Parts as catalog: one object, index, partition and allocation unit each."""
    part = load(spark, sf, "part")
    key = F.col("p_partkey")
    label = F.concat_ws(" ", "p_name", key.cast("string"))
    return {
        "objects": part.select(
            key.alias("object_id"),
            F.when(F.col("p_type") == "PROMO", 4).otherwise(F.col("p_size")).alias("schema_id"),
            label.alias("name"),
        ),
        "indexes": part.select(
            key.alias("object_id"), F.col("p_size").alias("index_id"), F.col("p_brand").alias("name"),
            F.when(F.col("p_type") == "SMALL", "CLUSTERED COLUMNSTORE").otherwise(F.col("p_type"))
            .alias("type_desc"), label.alias("table_name"),
        ),
        "partitions": part.select(
            key.alias("partition_id"), key.alias("object_id"), F.col("p_size").alias("index_id"),
            F.lit("NONE").alias("data_compression_desc"),
        ),
        "allocation_units": part.select(
            key.alias("allocation_unit_id"), key.alias("container_id"), F.col("p_type").alias("type_desc")
        ),
    }


@query(
    "buffer_pool_by_object",
    """WITH p AS (SELECT l_partkey, count(*) FILTER (WHERE l_linestatus = 'O') AS d,
        count(*) FILTER (WHERE l_linestatus <> 'O') AS c FROM lineitem GROUP BY l_partkey)
    SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS object_name, p_size AS index_id,
      p_brand AS index_name,
      CASE WHEN p_type = 'SMALL' THEN 'CLUSTERED COLUMNSTORE' ELSE p_type END AS index_type,
      p_type AS allocation_type, d AS dirty_page_count, c AS clean_page_count,
      d * 8 // 1024 AS dirty_page_mb, c * 8 // 1024 AS clean_page_mb
    FROM p JOIN part ON l_partkey = p_partkey WHERE p_partkey > 100""",
)
def buffer_pool_by_object(spark, sf):
    pages = load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("allocation_unit_id"),
        (F.col("l_linestatus") == "O").alias("is_modified"),
    )
    c = part_objects(spark, sf)
    return capacity.buffer_pool_by_object(
        pages, c["allocation_units"], c["partitions"], c["indexes"], c["objects"]
    )


LOG_USAGE = {
    "server": "c_name",
    "total_log_size_in_bytes": "(CAST(abs(round(c_acctbal * 100)) AS BIGINT) + 1000) * 4096",
    "used_log_space_in_bytes": "CAST(abs(round(c_acctbal * 100)) AS BIGINT) * 1000 + 7",
    "used_log_space_in_percent": "c_acctbal",
}


@query(
    "log_space",
    f"""WITH u AS (SELECT {sql_columns(LOG_USAGE)} FROM customer)
    SELECT server, total_log_size_in_bytes // 1048576 AS total_log_size_mb,
      (total_log_size_in_bytes - used_log_space_in_bytes) // 1048576 AS free_space_mb,
      {sql_ratio('used_log_space_in_bytes', '1048576', 20, 8)} AS used_log_space_mb,
      used_log_space_in_percent FROM u""",
)
def log_space(spark, sf):
    return capacity.log_space(derive(load(spark, sf, "customer"), LOG_USAGE), ["server"])


def _partition_stats(spark, sf: str) -> DataFrame:
    quantity = F.sum(F.col("l_quantity").cast("bigint"))
    return (
        load(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("partition_id"))
        .agg(
            F.count("*").alias("row_count"),
            (quantity * 400).alias("used_page_count"),
            (quantity * 400 + F.count("*")).alias("reserved_page_count"),
        )
    )


def _inventory(spark, sf: str, ordered: bool = True) -> DataFrame:
    c = part_objects(spark, sf)
    schemas = load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("schema_id"), F.col("n_name").alias("name")
    )
    return capacity.large_index_inventory(
        c["objects"], c["indexes"], c["partitions"], _partition_stats(spark, sf), schemas,
        ordered=ordered,
    )


_INVENTORY_SQL = """q AS (SELECT l_partkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)
        AS q, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT)
        AS rq FROM lineitem GROUP BY l_partkey),
    i AS (SELECT n_name AS schema_name, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS table_name,
        p_brand AS index_name, p_size AS index_id,
        CASE WHEN p_type = 'SMALL' THEN 'CLUSTERED COLUMNSTORE' ELSE p_type END AS type_desc,
        n AS row_count, q * 400 * 8 // 1024 AS size_used_mb, (q * 400 + n) * 8 // 1024 AS size_reserved_mb,
        'NONE' AS data_compression_desc, q, rq
      FROM q JOIN part ON l_partkey = p_partkey LEFT JOIN nation ON n_nationkey = p_size
      WHERE p_type <> 'PROMO' AND p_size <> 4 AND q * 400 * 8 // 1024 > 2000)"""


@query(
    "large_index_inventory",
    f"WITH {_INVENTORY_SQL} SELECT * EXCLUDE (q, rq) FROM i",
)
def large_index_inventory(spark, sf):
    return _inventory(spark, sf)


@query(
    "compression_savings",
    f"""WITH {_INVENTORY_SQL}
    SELECT '[' || schema_name || '].[' || table_name || ']' AS table_name,
      CASE WHEN index_id > 0 THEN '[' || index_name || ']' END AS index_name, type_desc, row_count,
      size_used_mb, q * 160 // 1024 AS estimated_compressed_size_mb,
      (size_used_mb * 1024 - q * 160) // 1024 AS estimated_saving_mb,
      {sql_ratio('q - rq', 'q', 7, 2, 100)} AS compression_saving_pct,
      'ALTER INDEX [' || index_name || '] ON  [' || schema_name || '].[' || table_name
        || '] REBUILD WITH ( DATA_COMPRESSION = PAGE)' AS command
    FROM i
    WHERE schema_name IS NOT NULL AND type_desc <> 'CLUSTERED COLUMNSTORE' AND q * 160 > 102400
      AND {sql_ratio('q - rq', 'q', 7, 2, 100)} > 5 AND (size_used_mb * 1024 - q * 160) // 1024 > 2000""",
)
def compression_savings(spark, sf):
    inventory = _inventory(spark, sf, ordered=False)
    quantity = F.sum(F.col("l_quantity").cast("bigint"))
    returned = F.coalesce(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint"))), F.lit(0)
    )
    sampled = (
        load(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(
            (quantity * 160).alias("size_with_requested_kb"),
            quantity.alias("sample_size_with_current_kb"),
            returned.alias("sample_size_with_requested_kb"),
        )
    )
    named = load(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("object_name"),
        F.col("p_size").alias("index_id"),
    )
    schemas = load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("index_id"), F.col("n_name").alias("schema_name")
    )
    estimates = sampled.join(named, "l_partkey").join(schemas, "index_id").withColumn(
        "partition_number", F.lit(1)
    )
    return capacity.compression_savings(inventory, estimates, part_objects(spark, sf)["indexes"])


PLANS = {
    "objtype": "CASE o_orderstatus WHEN 'P' THEN 'Adhoc' WHEN 'F' THEN 'Proc' ELSE 'Prepared' END",
    "cacheobjtype": "o_orderpriority",
    "usecounts": "CASE WHEN o_totalprice < 250000 THEN 1 ELSE 5 END",
    "refcounts": "CAST(o_custkey AS INT)",
    "size_in_bytes": "CAST(round(o_totalprice * 1000) AS BIGINT)",
}


@query(
    "plan_cache_single_use",
    f"""WITH p AS (SELECT {sql_columns(PLANS)} FROM orders)
    SELECT objtype, cacheobjtype, CAST(sum(usecounts) // count(*) AS BIGINT) AS avg_use_count,
      CAST(sum(refcounts) AS BIGINT) AS single_use_cached_plans,
      CAST(sum(size_in_bytes) // 1024 // 1024 AS BIGINT) AS size_mb
    FROM p WHERE objtype = 'Adhoc' AND usecounts = 1 GROUP BY ALL""",
)
def plan_cache_single_use(spark, sf):
    return capacity.plan_cache_single_use(derive(load(spark, sf, "orders"), PLANS))


@query(
    "plan_cache_summary",
    f"""WITH p AS (SELECT {sql_columns(PLANS)} FROM orders)
    SELECT objtype, cacheobjtype, count(*) AS count_plans, CAST(sum(refcounts) AS BIGINT) AS sum_refcounts,
      CAST(sum(size_in_bytes) // 1024 // 1024 AS BIGINT) AS size_mb
    FROM p GROUP BY ALL""",
)
def plan_cache_summary(spark, sf):
    return capacity.plan_cache_summary(derive(load(spark, sf, "orders"), PLANS))



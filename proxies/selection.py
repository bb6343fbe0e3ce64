"""Selection lists over parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import history, selection
from fleetlens.operators.selection import as_rules
from proxies.base import derive, load, query, sql_columns

# A list text per part, with line breaks and blanks around the delimiters.
LIST = "concat(p_brand, ' ,  -', p_type, ',\\r\\n', p_name, ' , [', p_name, ' ]] x],USER_DATABASES ')"
SQL_LIST = (
    "p_brand || ' ,  -' || p_type || ',' || chr(13) || chr(10) || p_name || ' , [' || p_name "
    "|| ' ]] x],USER_DATABASES '"
)

_SQL_ITEMS = f"""t AS (SELECT p_partkey, string_split(trim(regexp_replace(
        regexp_replace({SQL_LIST}, '[\\r\\n]', '', 'g'), ' *, *', ',', 'g')), ',') AS l FROM part),
    u AS (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS i FROM t),
    s AS (SELECT p_partkey, i, l[i] AS item,
        CAST(1 + coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) AS INTEGER)
          AS start_position FROM u)"""


def part_lists(spark, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.expr(LIST).alias("list"))


@query("split_list", f"WITH {_SQL_ITEMS} SELECT p_partkey, item, start_position FROM s")
def split_list(spark, sf):
    return selection.split_list(part_lists(spark, sf), "list", keep=["p_partkey"])


@query(
    "parse_rules",
    f"""WITH {_SQL_ITEMS}
    SELECT s.p_partkey, CASE i WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN p_name
        WHEN 4 THEN p_name || ' ] x' ELSE '%' END AS database_name,
      CASE i WHEN 5 THEN 'U' END AS database_type, CAST(NULL AS BOOLEAN) AS availability_group,
      start_position, i <> 2 AS selected
    FROM s JOIN part USING (p_partkey)""",
)
def parse_rules(spark, sf):
    items = selection.split_list(part_lists(spark, sf), "list", keep=["p_partkey"])
    return selection.parse_rules(items, "databases", keep=["p_partkey"])


@query(
    "parse_rules_index_names",
    """SELECT p_partkey, p_brand AS database_name, p_type AS schema_name, p_name AS object_name,
      '%' AS index_name, 1 AS start_position, TRUE AS selected FROM part
    UNION ALL SELECT p_partkey, p_brand, p_type || '.x', p_name, 'ix_%',
      CAST(length(p_brand || p_type || p_name) + 4 AS INTEGER), FALSE FROM part
    UNION ALL SELECT p_partkey, '%', '%', '%', '%',
      CAST(length(p_brand || p_type || p_name) * 2 + 17 AS INTEGER), TRUE FROM part""",
)
def parse_rules_index_names(spark, sf):
    # brand.type.name,-brand.[type.x].name.ix_%,ALL_INDEXES
    text = F.concat(
        "p_brand", F.lit("."), "p_type", F.lit("."), "p_name", F.lit(", -"), "p_brand",
        F.lit(".["), "p_type", F.lit(".x]."), "p_name", F.lit(".ix_%,ALL_INDEXES"),
    )
    lists = load(spark, sf, "part").select("p_partkey", text.alias("list"))
    items = selection.split_list(lists, "list", keep=["p_partkey"])
    return selection.parse_rules(items, "indexes", keep=["p_partkey"])


ITEMS = {
    "p_partkey": "p_partkey",
    "database_name": "p_name",
    "database_type": "CASE WHEN p_type = 'PROMO' THEN 'S' ELSE 'U' END",
    "availability_group": "p_size > 40",
    "server": "p_brand",
    "name": "concat(p_name, ' ', CAST(p_partkey AS STRING))",
}
RULES = "%GIZMO%, -red%,[small bolt],SYSTEM_DATABASES,h_t%"

_MATCH = {
    1: "database_name ILIKE '%gizmo%'",
    15: "database_name = 'small bolt'",
    28: "database_type = 'S'",
}


@query(
    "select_items",
    f"""WITH i AS (SELECT {sql_columns(ITEMS)} FROM part),
    m AS (SELECT p_partkey, CASE {' '.join(f'WHEN {c} THEN {p}' for p, c in _MATCH.items())} END
        AS start_position, database_name ILIKE 'red%' AS x FROM i)
    SELECT p_partkey, start_position IS NOT NULL AND NOT x AS selected, start_position FROM m""",
)
def select_items(spark, sf):
    items = derive(load(spark, sf, "part"), ITEMS)
    picked = selection.select_items(items, as_rules(spark, RULES), ["database_name"])
    return picked.select("p_partkey", "selected", "start_position")


@query(
    "select_items_per_server",
    f"""WITH i AS (SELECT {sql_columns(ITEMS)} FROM part),
    m AS (SELECT *, CASE WHEN database_name ILIKE 'small%' THEN 1
        WHEN database_name ILIKE 'hot gear' THEN 15
        WHEN database_name ILIKE '%' || right(server, 1) || '%' OR database_type = 'U' THEN 24 END
        AS p, database_name ILIKE '%bolt' AS x FROM i)
    SELECT p_partkey, p IS NOT NULL AND NOT x AS selected, p AS start_position FROM m""",
)
def select_items_per_server(spark, sf):
    items = derive(load(spark, sf, "part"), ITEMS)
    lists = items.select("server").distinct().withColumn(
        "list",
        F.concat(
            F.lit("small%,-%bolt,Hot Gear,%"), F.right("server", F.lit(1)), F.lit("%"),
            F.lit("\n, USER_DATABASES"),
        ),
    )
    rules = selection.parse_rules(
        selection.split_list(lists, "list", keep=["server"]), "databases", keep=["server"]
    )
    # The digit pattern matches no name; it and the keyword after it share the first position.
    rules = rules.withColumn(
        "start_position", F.when(F.col("start_position") > 24, 24).otherwise(F.col("start_position"))
    )
    picked = selection.select_items(items, rules, ["database_name"], keys=["server"])
    return picked.select("p_partkey", "selected", "start_position")


@query(
    "select_items_by_patterns",
    """WITH i AS (SELECT p_partkey, p_brand AS server, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name FROM part),
    r AS (SELECT p_brand AS server, p_partkey AS pos, p_partkey % 7 <> 0 AS yes,
        upper(left(p_name, 3)) || '%' || right(CAST(p_partkey AS VARCHAR), 2) AS pattern FROM part),
    m AS (SELECT i.p_partkey, min(pos) FILTER (yes) AS p, coalesce(bool_or(NOT yes), FALSE) AS x
      FROM i LEFT JOIN r ON r.server = i.server AND i.name ILIKE r.pattern GROUP BY i.p_partkey)
    SELECT p_partkey, p IS NOT NULL AND NOT x AS selected, CAST(p AS INTEGER) AS start_position FROM m""",
)
def select_items_by_patterns(spark, sf):
    """A pattern per part: three letters of the name, and the last two digits of the key."""
    part = load(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    items = part.select(
        "p_partkey", F.col("p_brand").alias("server"), F.concat("p_name", F.lit(" "), key).alias("database_name")
    )
    rules = part.select(
        F.col("p_brand").alias("server"),
        F.concat(F.upper(F.left("p_name", F.lit(3))), F.lit("%"), F.right(key, F.lit(2))).alias("database_name"),
        F.col("p_partkey").cast("int").alias("start_position"),
        (F.col("p_partkey") % 7 != 0).alias("selected"),
    )
    picked = selection.select_items(items, rules, ["database_name"], keys=["server"])
    return picked.select("p_partkey", "selected", "start_position")


@query(
    "select_by_group",
    """SELECT p_partkey, p_brand ILIKE 'Brand#1%' AND p_brand <> 'Brand#12' AS selected,
      CASE WHEN p_brand ILIKE 'Brand#1%' AND p_brand <> 'Brand#12' THEN 1 END AS start_position FROM part""",
)
def select_by_group(spark, sf):
    part = load(spark, sf, "part")
    names = part.select(F.col("p_brand").alias("group_name")).distinct()
    groups = selection.select_items(
        names, as_rules(spark, "brand#1%,-BRAND#12", "groups"), ["group_name"]
    )
    items = part.select("p_partkey", F.col("p_partkey").alias("database_name"))
    membership = part.select(
        F.col("p_partkey").alias("database_name"), F.col("p_brand").alias("group_name")
    )
    return selection.select_by_group(items, membership, groups).select(
        "p_partkey", "selected", "start_position"
    )


CUSTOMERS = {
    "name": "c_name",
    "selected": "c_mktsegment <> 'MACHINERY'",
    "start_position": "c_nationkey",
    "database_size": "CAST(abs(round(c_acctbal)) AS BIGINT)",
    "log_size": "CAST(abs(round(c_acctbal * 100)) AS BIGINT)",
    "last_good_check": "CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 97 END",
    "last_command_time": "CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 89 END",
}


def customer_items(spark, sf: str) -> DataFrame:
    return derive(load(spark, sf, "customer"), {"database_name": "c_custkey", **CUSTOMERS})


def _sql_order(order: str, source: str = "customer") -> str:
    return f"""WITH i AS (SELECT {sql_columns(CUSTOMERS)}, c_custkey FROM customer)
    SELECT name, row_number() OVER (ORDER BY {order}) AS item_order FROM i WHERE selected"""


@query("order_items_default", _sql_order("start_position, name"))
def order_items_default(spark, sf):
    return selection.order_items(customer_items(spark, sf)).select("name", "item_order")


@query("order_items_by_size", _sql_order("database_size DESC, name"))
def order_items_by_size(spark, sf):
    return selection.order_items(customer_items(spark, sf), "DATABASE_SIZE_DESC").select(
        "name", "item_order"
    )


#: The orders that no query above or below asks for; an unread time is NULL.
for _mode, _order in (
    ("DATABASE_NAME_ASC", "name"),
    ("DATABASE_NAME_DESC", "name DESC"),
    ("DATABASE_SIZE_ASC", "database_size, name"),
    ("LOG_SIZE_SINCE_LAST_LOG_BACKUP_DESC", "log_size DESC, name"),
    ("DATABASE_LAST_GOOD_CHECK_ASC", "last_good_check NULLS FIRST, name"),
    ("DATABASE_LAST_GOOD_CHECK_DESC", "last_good_check DESC NULLS LAST, name"),
    ("REPLICA_LAST_GOOD_CHECK_DESC", "last_command_time DESC NULLS LAST, name"),
):

    @query(f"order_items_{_mode.lower()}", _sql_order(_order))
    def _ordered(spark, sf, mode=_mode):
        return selection.order_items(customer_items(spark, sf), mode).select("name", "item_order")


@query(
    "order_items_per_server",
    f"""WITH i AS (SELECT {sql_columns(CUSTOMERS)} FROM customer)
    SELECT start_position AS server, name,
      row_number() OVER (PARTITION BY start_position ORDER BY log_size, name) AS item_order
    FROM i WHERE selected""",
)
def order_items_per_server(spark, sf):
    items = customer_items(spark, sf).withColumn("server", F.col("start_position"))
    ordered = selection.order_items(
        items, "LOG_SIZE_SINCE_LAST_LOG_BACKUP_ASC", ["server"], bounded=False
    )
    return ordered.select("server", "name", "item_order")


@query(
    "order_items_by_last_check",
    f"""WITH i AS (SELECT {sql_columns(CUSTOMERS)}, c_custkey FROM customer),
    l AS (SELECT o_custkey, max(o_orderdate) AS last_command_time FROM orders
      WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT name, l.last_command_time,
      row_number() OVER (ORDER BY l.last_command_time NULLS FIRST, name) AS item_order
    FROM i LEFT JOIN l ON c_custkey = o_custkey WHERE selected""",
)
def order_items_by_last_check(spark, sf):
    log = derive(
        load(spark, sf, "orders"),
        {
            "database_name": "o_custkey",
            "command_type": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'DBCC_CHECKDB' ELSE 'X' END",
            "error_number": "CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END",
            "start_time": "o_orderdate",
        },
    )
    last = history.last_success(log).withColumnRenamed("max_start_time", "last_command_time")
    items = customer_items(spark, sf).drop("last_command_time").join(last, "database_name", "left")
    return selection.order_items(items, "REPLICA_LAST_GOOD_CHECK_ASC").select(
        "name", "last_command_time", "item_order"
    )


@query(
    "database_sizes",
    """SELECT l_suppkey AS database_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS database_size
    FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey""",
)
def database_sizes(spark, sf):
    files = derive(
        load(spark, sf, "lineitem"),
        {
            "database_id": "l_suppkey",
            "type": "CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END",
            "size": "CAST(l_quantity AS BIGINT)",
        },
    )
    return selection.database_sizes(files)


NAMED = "small ring,purple [cow,-Red Widget,%bolt,[no ]] such],HOT GEAR,-lost"


@query(
    "missing_items",
    """WITH n(x) AS (VALUES ('small ring'), ('purple [cow'), ('Red Widget'), ('no ] such'), ('HOT GEAR'),
      ('lost')), m AS (SELECT '[' || replace(x, ']', ']]') || ']' AS q FROM n
      WHERE lower(x) NOT IN (SELECT lower(p_name) FROM part))
    SELECT string_agg(q, ', ' ORDER BY q) AS names, count(*) AS n_names FROM m""",
)
def missing_items(spark, sf):
    items = derive(load(spark, sf, "part"), ITEMS)
    return selection.missing_items(as_rules(spark, NAMED), items)


@query(
    "missing_index_objects",
    """WITH n(b, t, x) AS (VALUES ('Brand#1', 'PROMO', 'red ring'), ('brand#2', 'small', 'cold gear'),
      ('Brand#99', 'PROMO', 'old bolt')),
    m AS (SELECT '[' || b || '].[' || t || '].[' || x || ']' AS q FROM n
      WHERE NOT EXISTS (SELECT * FROM part WHERE lower(p_brand) = lower(b) AND lower(p_type) = lower(t)
        AND lower(p_name) = lower(x)))
    SELECT string_agg(q, ', ' ORDER BY q) AS names, count(*) AS n_names FROM m""",
)
def missing_index_objects(spark, sf):
    text = "Brand#1.PROMO.red ring, brand#2.small.cold gear,[Brand#99].PROMO.old bolt,Brand#1.x.y.ix1"
    items = derive(
        load(spark, sf, "part"),
        {"database_name": "p_brand", "schema_name": "p_type", "object_name": "p_name"},
    )
    return selection.missing_items(
        as_rules(spark, text, "indexes"), items, ["database_name", "schema_name", "object_name"],
        pattern="index_name",
    )


@query(
    "selected_elsewhere_not_here",
    """WITH n(x) AS (VALUES ('small ring'), ('purple [cow'), ('Red Widget'), ('no ] such'), ('HOT GEAR'),
      ('lost')), m AS (SELECT '[' || x || ']' AS q FROM n
      WHERE lower(x) IN (SELECT lower(p_name) FROM part)
        AND lower(x) NOT IN (SELECT lower(p_name) FROM part WHERE p_name LIKE 'small%'))
    SELECT string_agg(q, ', ' ORDER BY q) AS names, count(*) AS n_names FROM m""",
)
def selected_elsewhere_not_here(spark, sf):
    items = derive(load(spark, sf, "part"), {**ITEMS, "selected": "p_name LIKE 'small%'"})
    return selection.selected_elsewhere_not_here(as_rules(spark, NAMED), items)


CLASHING = {
    "p_partkey": "p_partkey",
    "name": "concat(CASE WHEN p_type = 'PROMO' THEN '' ELSE CASE WHEN p_size > 25 THEN p_name "
    "ELSE upper(p_name) END END, CASE WHEN p_size > 10 THEN '?' ELSE '<|' END, "
    "CASE WHEN p_type = 'PROMO' THEN '' ELSE p_brand END, ' ')",
    "selected": "p_size > 45",
}


@query(
    "fs_name_conflicts",
    f"""WITH i AS (SELECT {sql_columns(CLASHING)} FROM part),
    f AS (SELECT *, rtrim(translate(name, '\\/:*?"<>|', '')) AS name_fs FROM i),
    g AS (SELECT *, count(*) OVER (PARTITION BY upper(name_fs)) AS n,
      bool_or(selected) OVER (PARTITION BY upper(name_fs)) AS any_selected FROM f)
    SELECT p_partkey, name, name_fs, CASE WHEN name_fs = '' THEN 'EMPTY' ELSE 'DUPLICATE' END AS problem
    FROM g WHERE (name_fs = '' AND selected) OR (name_fs <> '' AND n > 1 AND any_selected)""",
)
def fs_name_conflicts(spark, sf):
    items = derive(load(spark, sf, "part"), CLASHING)
    return selection.fs_name_conflicts(items, keep=["p_partkey"])


QUEUE = {"database_name": "c_custkey", "item_order": "c_nationkey", "retries": "c_nationkey + 1"}
WANTED = {
    "database_name": "c_custkey",
    "item_order": "CAST(c_custkey AS INT)",
    "selected": "c_mktsegment IN ('MACHINERY', 'FURNITURE')",
}


@query(
    "sync_worklist",
    """SELECT c_custkey AS database_name,
      CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey ELSE c_custkey END AS INTEGER) AS item_order,
      CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_nationkey + 1 END AS retries,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'DELETE' WHEN 'FURNITURE' THEN 'INSERT' ELSE 'UPDATE' END
        AS action
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')""",
)
def sync_worklist(spark, sf):
    customers = load(spark, sf, "customer")
    queue = derive(customers.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')"), QUEUE)
    return selection.sync_worklist(queue, derive(customers, WANTED), ["database_name"])


WORK = {
    "id": "o_orderkey",
    "item_order": "o_custkey",
    "completed": "CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END",
}


@query(
    "pending",
    "SELECT o_orderkey AS id, o_custkey AS item_order FROM orders WHERE o_orderstatus <> 'F'",
)
def pending(spark, sf):
    return selection.pending(derive(load(spark, sf, "orders"), WORK)).select("id", "item_order")


@query(
    "mark_done",
    """SELECT o_orderkey AS id, o_custkey AS item_order,
      o_orderstatus = 'F' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
        AS completed FROM orders""",
)
def mark_done(spark, sf):
    finished = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("id")
    )
    return selection.mark_done(derive(load(spark, sf, "orders"), WORK), finished, ["id"])


@query(
    "validate_choices",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n_values FROM orders GROUP BY 1)
    SELECT o_orderpriority, 'NOT_ALLOWED' AS problem, n_values FROM c
      WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
    UNION ALL SELECT o_orderpriority, 'DUPLICATE', n_values FROM c WHERE n_values > 1""",
)
def validate_choices(spark, sf):
    return selection.validate_choices(
        load(spark, sf, "orders").select("o_orderpriority"), "o_orderpriority",
        ["1-URGENT", "2-HIGH", "5-LOW"],
    )



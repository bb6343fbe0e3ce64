"""Replicas, jobs, settings and permissions derived from nations, suppliers, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import compliance
from proxies.base import derive, load, query, sql_columns

# Regions are availability groups, nations their replicas, customers' databases live on nations.
REPLICAS = {
    "region": "n_regionkey",
    "name": "n_name",
    "role": "CASE WHEN n_nationkey < 5 THEN 'Primary' ELSE 'Secondary' END",
    "seeding_mode": "CASE WHEN n_nationkey % 2 = 0 THEN 'Automatic' ELSE 'Manual' END",
    "version_major": "CASE WHEN n_nationkey > 12 THEN 15 ELSE 12 END",
}


@query(
    "missing_on_replica",
    f"""WITH r AS (SELECT {sql_columns(REPLICAS)} FROM nation),
    d AS (SELECT DISTINCT CAST(c_custkey % 5 AS INTEGER) AS region, c_name AS database_name,
        CASE WHEN c_acctbal < 0 THEN 'Simple' ELSE 'Full' END AS recovery_model
      FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    p AS (SELECT DISTINCT n_regionkey AS region, n_name AS replica, c_name AS database_name
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON CAST(o_orderkey % 25 AS INTEGER) = n_nationkey)
    SELECT d.region, d.database_name, r.name AS replica,
      CASE WHEN seeding_mode = 'Automatic' AND version_major >= 13 THEN 'AUTOMATIC_SEEDING'
        ELSE 'BACKUP_RESTORE' END AS method, recovery_model <> 'Full' AS set_recovery_model_full
    FROM d JOIN r USING (region) WHERE r.role = 'Secondary' AND NOT EXISTS (SELECT * FROM p
      WHERE p.region = d.region AND p.database_name = d.database_name AND p.replica = r.name)""",
)
def missing_on_replica(spark, sf):
    customers, nations = load(spark, sf, "customer"), load(spark, sf, "nation")
    databases = customers.select(
        (F.col("c_custkey") % 5).cast("int").alias("region"),
        F.col("c_name").alias("database_name"),
        F.when(F.col("c_acctbal") < 0, "Simple").otherwise("Full").alias("recovery_model"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Offline").otherwise("Normal").alias("status"),
    )
    present = (
        load(spark, sf, "orders")
        .select(
            F.col("o_custkey").alias("c_custkey"),
            (F.col("o_orderkey") % 25).cast("int").alias("n_nationkey"),
        )
        .join(customers.select("c_custkey", F.col("c_name").alias("database_name")), "c_custkey")
        .join(nations, "n_nationkey")
        .select(F.col("n_regionkey").alias("region"), "database_name", F.col("n_name").alias("replica"))
    )
    return compliance.missing_on_replica(databases, derive(nations, REPLICAS), present, ["region"])


@query(
    "unscheduled_jobs",
    """SELECT c_custkey AS job_id, c_mktsegment AS name FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS (SELECT * FROM orders
      WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def unscheduled_jobs(spark, sf):
    jobs = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("name")
    )
    schedules = load(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("job_id")
    )
    return compliance.unscheduled_jobs(jobs, schedules, ["BUILDING", "MACHINERY"])


FACTS = {
    "resource": "c_name",
    "name": "CASE c_mktsegment WHEN 'BUILDING' THEN 'PowerPlan' WHEN 'MACHINERY' THEN 'BlockSize' "
    "WHEN 'FURNITURE' THEN 'IndexingEnabled' WHEN 'HOUSEHOLD' THEN 'LogCount' ELSE 'Other' END",
    "value": "CASE WHEN c_acctbal < 0 THEN NULL ELSE CASE c_mktsegment "
    "WHEN 'BUILDING' THEN CASE WHEN c_nationkey < 10 THEN 'high performance' ELSE 'Balanced' END "
    "WHEN 'MACHINERY' THEN CASE WHEN c_nationkey < 10 THEN '65536.0' ELSE '4096' END "
    "WHEN 'FURNITURE' THEN CASE WHEN c_nationkey < 10 THEN 'False' ELSE 'True' END "
    "ELSE CAST(c_nationkey + 10 AS STRING) END END",
}


@query(
    "config_expectations",
    f"""WITH f AS (SELECT {sql_columns(FACTS)} FROM customer),
    j AS (SELECT *, coalesce(CASE name WHEN 'PowerPlan' THEN value = 'high performance'
        WHEN 'BlockSize' THEN value = '65536.0' WHEN 'IndexingEnabled' THEN value = 'False'
        ELSE value = '30' END, FALSE) AS passed FROM f WHERE name <> 'Other')
    SELECT resource, name, value, 'eq' AS op, CASE name WHEN 'PowerPlan' THEN 'High Performance'
      WHEN 'BlockSize' THEN '65536' WHEN 'IndexingEnabled' THEN 'false' ELSE '30' END AS expected, passed,
      CASE WHEN NOT passed THEN CASE name
        {' '.join("WHEN '" + n + "' THEN '" + r.replace("'", "''") + "'" for n, _, _, r in compliance.BEST_PRACTICE_RULES)}
      END END AS reason FROM j""",
)
def config_expectations(spark, sf):
    return compliance.config_expectations(derive(load(spark, sf, "customer"), FACTS))


CLUSTER = {
    "resource": "s_name",
    "owner_group": "concat('Group', CAST(s_nationkey AS STRING))",
    "ip": "CASE WHEN s_acctbal < 5000 THEN '1' ELSE '0' END",
    "ttl": "CASE WHEN s_nationkey < 12 THEN '1200' ELSE '300' END",
}


@query(
    "cluster_remediation",
    f"""WITH c AS (SELECT {sql_columns(CLUSTER)} FROM supplier)
    SELECT resource, 1 AS step, 'Get-ClusterResource ''' || resource
      || ''' | Set-ClusterParameter RegisterAllProvidersIP 0' AS command FROM c WHERE ip = '1'
    UNION ALL SELECT resource, 2, 'Get-ClusterResource ''' || resource
      || ''' | Set-ClusterParameter HostRecordTTL 300' FROM c WHERE ttl = '1200'
    UNION ALL SELECT resource, 3, 'Stop-ClusterResource ''' || resource || '''' FROM c WHERE ip = '1' OR ttl = '1200'
    UNION ALL SELECT resource, 4, 'Start-ClusterResource ''' || resource || '''' FROM c WHERE ip = '1' OR ttl = '1200'
    UNION ALL SELECT resource, 5, 'Start-Clustergroup ''' || owner_group || '''' FROM c WHERE ip = '1' OR ttl = '1200'""",
)
def cluster_remediation(spark, sf):
    facts = derive(load(spark, sf, "supplier"), CLUSTER).select(
        "resource", "owner_group",
        F.expr("stack(2, 'RegisterAllProvidersIP', ip, 'HostRecordTTL', ttl)").alias("name", "value"),
    )
    return compliance.cluster_remediation(facts)


@query(
    "option_state_drift",
    """SELECT o_orderkey AS server, o_orderpriority AS name, o_orderstatus AS desired_state_desc,
      CASE WHEN o_totalprice > 100000 THEN 'F' END AS actual_state_desc, 'x' AS reason_desc FROM orders
    WHERE o_orderstatus IS DISTINCT FROM CASE WHEN o_totalprice > 100000 THEN 'F' END""",
)
def option_state_drift(spark, sf):
    options = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("server"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("desired_state_desc"),
        F.when(F.col("o_totalprice") > 100000, "F").alias("actual_state_desc"),
        F.lit("x").alias("reason_desc"),
    )
    return compliance.option_state_drift(options, ["server"])


# --- permissions: a nation is a database, its customers are principals ----------------------------

PRINCIPALS = {
    "server": "c_nationkey",
    "principal_id": "CAST(c_custkey AS INT)",
    "name": "CASE WHEN c_custkey = 7 THEN 'guest' ELSE c_name END",
    "type": "CASE c_mktsegment WHEN 'BUILDING' THEN 'U' WHEN 'MACHINERY' THEN 'S' WHEN 'FURNITURE' THEN 'G' "
    "ELSE 'R' END",
    "default_schema_name": "CASE WHEN c_acctbal < 0 THEN NULL ELSE 'app' END",
    "authentication_type": "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END",
    "login_name": "CASE WHEN c_custkey % 10 <> 4 THEN lower(c_name) END",
    "is_fixed_role": "c_custkey % 6 = 0",
    "sid_text": "CAST(c_custkey AS STRING)",
}
LOGINS = {
    "server": "c_nationkey",
    "name": "upper(c_name)",
    "sid_text": "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE 'other' END",
}
MEMBERS = {
    "server": "c_nationkey",
    "role_principal_id": "CAST(o_orderkey % 1500 AS INT)",
    "member_principal_id": "CAST(o_custkey AS INT)",
}
PERMISSIONS = {
    "server": "c_nationkey",
    "class": "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 6 ELSE 1 END",
    "class_desc": "CASE o_orderpriority WHEN '1-URGENT' THEN 'DATABASE' WHEN '2-HIGH' THEN 'SCHEMA' ELSE 'OBJECT' END",
    "major_id": "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN CAST(o_orderkey % 25 AS INT) "
    "ELSE CAST(100 + o_orderkey % 100 AS INT) END",
    "minor_id": "CAST(o_orderkey % 4 AS INT)",
    "grantee_principal_id": "CAST(o_custkey AS INT)",
    "state": "CASE o_orderstatus WHEN 'F' THEN 'W' WHEN 'O' THEN 'G' ELSE 'D' END",
    "state_desc": "CASE o_orderstatus WHEN 'F' THEN 'GRANT_WITH_GRANT_OPTION' WHEN 'O' THEN 'GRANT' ELSE 'DENY' END",
    "permission_name": "CASE WHEN o_totalprice < 200000 THEN 'SELECT' ELSE 'EXECUTE' END",
}
# Every server has the same objects, columns, types and schemas, taken from parts and nations.
OBJECTS = {
    "object_id": "CAST(p_partkey AS INT)",
    "name": "concat(p_name, ']')",
    "schema_name": "p_brand",
    "type": "CASE p_type WHEN 'PROMO' THEN 'S ' ELSE 'U ' END",
}


def _permission_tables(spark, sf: str) -> dict[str, DataFrame]:
    customers, part, nations = (load(spark, sf, t) for t in ("customer", "part", "nation"))
    orders = load(spark, sf, "orders").join(
        customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    )
    sid = F.encode("sid_text", "UTF-8").alias("sid")
    servers = nations.select(F.col("n_nationkey").alias("server"))

    def everywhere(rows: DataFrame) -> DataFrame:
        # The catalog of every server: a row per server, generated without a join.
        all_servers = F.explode(F.sequence(F.lit(0), F.lit(24)))
        return rows.select(all_servers.alias("server"), *rows.columns)

    return {
        "principals": derive(customers, PRINCIPALS).select("*", sid).drop("sid_text"),
        "server_principals": derive(customers, LOGINS).select("*", sid).drop("sid_text"),
        "members": derive(orders, MEMBERS),
        "permissions": derive(orders, PERMISSIONS),
        "objects": everywhere(derive(part, OBJECTS)),
        "columns": everywhere(
            part.select(
                F.col("p_partkey").cast("int").alias("object_id"),
                (F.col("p_size") % 4).alias("column_id"),
                F.col("p_name").alias("name"),
            )
        ),
        "types": everywhere(
            nations.select(
                (F.col("n_nationkey") + 150).alias("user_type_id"),
                F.concat(F.lit("T"), "n_name").alias("name"),
                F.col("n_regionkey").alias("schema_id"),
            )
        ),
        "schemas": everywhere(
            nations.select(F.col("n_nationkey").alias("schema_id"), F.col("n_name").alias("name"))
        ),
        "databases": servers.withColumn(
            "database_name",
            F.when(F.col("server") == 3, "master").otherwise(
                F.concat(F.lit("DB"), F.col("server").cast("string"))
            ),
        ),
    }


def _quoted(c: str, q: str = "[") -> str:
    if q == "[":
        return f"'[' || replace({c}, ']', ']]') || ']'"
    return f"'''' || replace({c}, '''', '''''') || ''''"


_GUARD = f"""'IF DATABASE_PRINCIPAL_ID(' || {_quoted('u.name', "'")} || ') IS NOT NULL '
      || CASE WHEN state <> 'W' THEN state_desc ELSE 'GRANT' END || ' ' || permission_name"""
_OPTION = "CASE WHEN state <> 'W' THEN '' ELSE ' WITH GRANT OPTION' END"
_TO = f"' TO ' || {_quoted('u.name')} || {_OPTION}"

_SQL_PERMISSIONS = f"""WITH principals AS (SELECT {sql_columns(PRINCIPALS)} FROM customer),
    logins AS (SELECT {sql_columns(LOGINS)} FROM customer),
    o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
    members AS (SELECT {sql_columns(MEMBERS)} FROM o),
    permissions AS (SELECT {sql_columns(PERMISSIONS)} FROM o),
    objects AS (SELECT {sql_columns(OBJECTS)} FROM part),
    databases AS (SELECT n_nationkey AS server, CASE n_nationkey WHEN 3 THEN 'master'
      ELSE 'DB' || CAST(n_nationkey AS VARCHAR) END AS database_name FROM nation),
    headers(statement, result_order) AS (VALUES ('-- [-- DB CONTEXT --] --', 1.0), ('', 2.0),
      ('-- [-- DB USERS --] --', 3.0), ('-- [-- ORPHANED USERS --] --', 4.0), ('-- [-- DB ROLES --] --', 5.0),
      ('', 7.0), ('-- [-- OBJECT LEVEL PERMISSIONS --] --', 7.1), ('-- [-- TYPE LEVEL PERMISSIONS --] --', 8.0),
      ('', 9.0), ('-- [--DB LEVEL PERMISSIONS --] --', 10.0), ('', 11.0),
      ('-- [--DB LEVEL SCHEMA PERMISSIONS --] --', 12.0)),
    created AS (SELECT server, 'IF NOT EXISTS (SELECT [name] FROM sys.database_principals WHERE [name] =  '''
        || name || ''') BEGIN CREATE USER  [' || name || ']' || CASE WHEN authentication_type = 0
        THEN ' WITHOUT LOGIN WITH DEFAULT_SCHEMA = [' || default_schema_name || '] , SID = 0x'
          || upper(hex(encode(sid_text))) || '  END; '
        ELSE ' FOR LOGIN [' || login_name || ']' || CASE WHEN type <> 'G' THEN ' WITH DEFAULT_SCHEMA = ['
          || coalesce(default_schema_name, 'dbo') || ']' ELSE '' END || ' END; ' END AS statement
      FROM principals WHERE type IN ('U', 'S', 'G') AND name NOT IN ('guest', 'dbo')),
    everything AS (
      SELECT server, statement, result_order FROM databases, headers
      UNION SELECT server, 'USE [' || database_name || ']', 1.1 FROM databases
      UNION SELECT server, statement, 3.1 FROM created WHERE statement IS NOT NULL
      UNION SELECT p.server, 'ALTER USER [' || p.name || '] WITH LOGIN = [' || p.name || ']', 4.1
        FROM principals p JOIN logins l ON p.server = l.server AND lower(p.name) = lower(l.name)
          AND p.sid_text <> l.sid_text WHERE type IN ('U', 'S', 'G') AND p.name <> 'guest'
      UNION SELECT server, 'IF DATABASE_PRINCIPAL_ID(' || {_quoted('name', "'")} || ') IS NULL CREATE ROLE ['
        || name || ']', 5.1 FROM principals WHERE type = 'R' AND NOT is_fixed_role
      UNION SELECT m.server, 'IF DATABASE_PRINCIPAL_ID(' || {_quoted('u.name', "'")}
        || ') IS NOT NULL EXEC sp_addrolemember @rolename = ' || {_quoted('r.name', "'")}
        || ', @membername = ' || {_quoted('u.name', "'")}, 5.2
        FROM members m JOIN principals u ON m.server = u.server AND m.member_principal_id = u.principal_id
          LEFT JOIN principals r ON m.server = r.server AND m.role_principal_id = r.principal_id
        WHERE u.principal_id > 4 AND u.type IN ('G', 'S', 'U')
      UNION SELECT p.server, {_GUARD} || ' ON [' || schema_name || '].' || {_quoted('b.name')}
        || CASE WHEN c.p_name IS NULL THEN '' ELSE '([' || c.p_name || '])' END || {_TO}, 7.2
        FROM permissions p JOIN principals u ON p.server = u.server AND grantee_principal_id = u.principal_id
          JOIN databases d ON p.server = d.server LEFT JOIN objects b ON major_id = b.object_id
          LEFT JOIN part c ON major_id = c.p_partkey AND minor_id = c.p_size % 4
        WHERE database_name = 'master' OR rtrim(b.type) <> 'S'
      UNION SELECT p.server, {_GUARD} || ' ON [' || s.n_name || '].[T' || t.n_name || ']' || {_TO}, 8.1
        FROM permissions p JOIN principals u ON p.server = u.server AND grantee_principal_id = u.principal_id
          JOIN nation t ON major_id = t.n_nationkey + 150 LEFT JOIN nation s ON t.n_regionkey = s.n_nationkey
      UNION SELECT p.server, {_GUARD} || ' TO [' || u.name || ']' || {_OPTION}, 10.1
        FROM permissions p JOIN principals u ON p.server = u.server AND grantee_principal_id = u.principal_id
        WHERE major_id = 0 AND u.principal_id > 4
      UNION SELECT p.server, {_GUARD} || ' ON ' || class_desc || '::[' || s.n_name || ']' || {_TO}, 12.1
        FROM permissions p JOIN principals u ON p.server = u.server AND grantee_principal_id = u.principal_id
          JOIN nation s ON major_id = s.n_nationkey WHERE class = 3)
    SELECT server, statement, CAST(result_order AS DOUBLE) AS result_order FROM everything"""


@query("permission_statements", _SQL_PERMISSIONS)
def permission_statements(spark, sf):
    return compliance.permission_statements(**_permission_tables(spark, sf), keys=["server"])


@query(
    "orphaned_users",
    f"""WITH principals AS (SELECT {sql_columns(PRINCIPALS)} FROM customer),
    logins AS (SELECT {sql_columns(LOGINS)} FROM customer)
    SELECT p.server, p.name, 'ALTER USER [' || p.name || '] WITH LOGIN = [' || p.name || ']' AS statement
    FROM principals p JOIN logins l ON p.server = l.server AND lower(p.name) = lower(l.name)
      AND p.sid_text <> l.sid_text WHERE type IN ('U', 'S', 'G') AND p.name <> 'guest'""",
)
def orphaned_users(spark, sf):
    tables = _permission_tables(spark, sf)
    return compliance.orphaned_users(
        tables["principals"], tables["server_principals"], ["server"]
    ).select("server", "name", "statement")


@query(
    "fleet_inventory",
    """SELECT s_suppkey AS server, n_name AS computer_name, r_name AS instance_name,
      'Primary' AS local_replica_role, s_name AS listener
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE 'x Prod ' || r_name ILIKE '%prod%a%'""",
)
def fleet_inventory(spark, sf):
    suppliers, nations, regions = (load(spark, sf, t) for t in ("supplier", "nation", "region"))
    located = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    servers = located.select(
        F.col("s_suppkey").alias("server"),
        F.concat(F.lit("x Prod "), "r_name").alias("server_group"),
    )
    groups = located.select(
        F.col("s_suppkey").alias("server"),
        F.col("n_name").alias("computer_name"),
        F.col("r_name").alias("instance_name"),
        F.lit("Primary").alias("local_replica_role"),
        F.col("s_name").alias("listener"),
    )
    return compliance.fleet_inventory(servers, groups, "*PROD*A*")

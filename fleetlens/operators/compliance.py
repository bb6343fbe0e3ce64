"""Replica coverage, job schedules, configuration rules, permissions and inventory."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import concat_text, like_regex, quote_name
from fleetlens.operators.distributed import BROADCAST_ROWS, all_of, sized_for_join

# Fixed value: first major version with automatic seeding.
SEEDING_VERSION = 13

# Maintenance jobs that must have a schedule.
SCHEDULED_JOBS = [
    "CommandLog Cleanup",
    "Output File Cleanup",
    "sp_delete_backuphistory",
    "sp_purge_jobhistory",
    "syspolicy_purge_history",
]

# Best-practice settings as (name, operator, expected, reason).
BEST_PRACTICE_RULES = [
    (
        "PowerPlan",
        "eq",
        "High Performance",
        "This Power Plan increases performance at the cost of high energy consumption",
    ),
    (
        "BlockSize",
        "eq",
        "65536",
        "It is recommended to set a File Allocation Unit Size value to 64 KB on partitions where "
        "resides SQL Server data or log files",
    ),
    (
        "IndexingEnabled",
        "eq",
        "false",
        "It is recommended to disable 'Allow files on this drive to have contents indexed' in disk "
        "option, for SQL Server drives. For performance reason, especially when Filestream feature "
        "is used",
    ),
    (
        "LogCount",
        "eq",
        "30",
        "Best practices requires 30 logs files to perform daily recycling",
    ),
]

# Cluster parameters for multi-subnet listeners, as (name, operator, expected, fix).
CLUSTER_DRIFT_RULES = [
    ("RegisterAllProvidersIP", "ne", "1", "0"),
    ("HostRecordTTL", "le", "300", "300"),
]

# Names that are never orphaned users; user types; last fixed principal id.
SYSTEM_USERS = ["dbo", "guest", "INFORMATION_SCHEMA", "sys", "MS_DataCollectorInternalUser"]
USER_TYPES = ["U", "S", "G"]
LAST_FIXED_PRINCIPAL = 4

_COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def missing_on_replica(
    databases: DataFrame,
    replicas: DataFrame,
    replica_databases: DataFrame,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Databases of a primary that a secondary replica lacks, and how to create them there.

    Only databases in state NORMAL count.  A group has few replicas, so they travel as an array;
    only missing (database, replica) pairs become rows.
    """
    k = list(keys)
    secondaries = replicas.filter("role = 'Secondary'").groupBy(*k).agg(
        F.collect_set(F.struct("name", "seeding_mode", "version_major")).alias("_secondaries")
    )
    present = replica_databases.groupBy(*k, "database_name").agg(
        F.collect_set("replica").alias("_present")
    )
    normal = databases.filter("status = 'Normal'").select(*k, "database_name", "recovery_model")
    if k:
        expected = normal.join(secondaries, k)
    else:
        # One group: its few replicas are one value, so no row needs a join to meet them.
        expected = normal.withColumn("_secondaries", secondaries.scalar())
    joined = expected.join(present, [*k, "database_name"], "left")
    absent = F.filter(
        "_secondaries",
        lambda s: ~F.coalesce(F.array_contains(F.col("_present"), s["name"]), F.lit(False)),
    )
    automatic = (F.col("_s.seeding_mode") == "Automatic") & (
        F.col("_s.version_major") >= SEEDING_VERSION
    )
    return joined.withColumn("_s", F.explode(absent)).select(
        *k,
        "database_name",
        F.col("_s.name").alias("replica"),
        F.when(automatic, "AUTOMATIC_SEEDING").otherwise("BACKUP_RESTORE").alias("method"),
        (F.lower("recovery_model") != "full").alias("set_recovery_model_full"),
    )


def unscheduled_jobs(
    jobs: DataFrame,
    schedules: DataFrame,
    names: Sequence[str] = tuple(SCHEDULED_JOBS),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Jobs of the list without any schedule."""
    return (
        jobs.filter(F.col("name").isin(*names))
        .join(schedules.select(*keys, "job_id"), [*keys, "job_id"], "left_anti")
        .select(*keys, "job_id", "name")
    )


def _holds(op: str, value: Column, expected: Column) -> Column:
    """Numeric comparison when both sides are numbers, else case-insensitive text comparison."""
    left, right = value.try_cast("double"), expected.try_cast("double")
    compare = _COMPARE[op]
    return F.when(left.isNotNull() & right.isNotNull(), compare(left, right)).otherwise(
        compare(F.lower(value), F.lower(expected))
    )


def config_expectations(
    facts: DataFrame, rules: Sequence[tuple] | DataFrame = tuple(BEST_PRACTICE_RULES)
) -> DataFrame:
    """Facts (``resource``, ``name``, ``value``) against expected values: ``passed`` and why.

    ``rules`` are (name, operator, expected, reason) tuples or such a DataFrame.  A missing value
    fails.
    """
    if not isinstance(rules, DataFrame):
        listed = facts.sparkSession.createDataFrame(
            [tuple(r) for r in rules], "name string, op string, expected string, reason string"
        )
        # A literal list: its length is known here.
        rules = F.broadcast(listed) if len(rules) <= BROADCAST_ROWS else listed
    passed = F.lit(None).cast("boolean")
    for op in _COMPARE:
        passed = F.when(
            F.col("op") == op, _holds(op, F.col("value"), F.col("expected"))
        ).otherwise(passed)
    return (
        facts.join(rules, "name")
        .withColumn("passed", F.coalesce(passed, F.lit(False)))
        .select(*facts.columns, "op", "expected", "passed",
                F.when(~F.col("passed"), F.col("reason")).alias("reason"))
    )


def cluster_remediation(
    facts: DataFrame, rules: Sequence[tuple] = tuple(CLUSTER_DRIFT_RULES), keys: Sequence[str] = ()
) -> DataFrame:
    """Commands that correct drifted cluster parameters, followed by the restarts they need.

    Input: ``resource``, ``owner_group``, ``name``, ``value``.  One row per command, with its
    ``step`` within the resource.
    """
    checked = config_expectations(facts, rules)
    drifted = checked.filter(~F.col("passed") & F.col("value").isNotNull())
    order = F.lit(None).cast("int")
    for i, rule in enumerate(rules):
        order = F.when(F.col("name") == rule[0], i + 1).otherwise(order)
    fixes = drifted.select(
        *keys,
        "resource",
        order.alias("step"),
        concat_text(
            "Get-ClusterResource '",
            F.col("resource"),
            "' | Set-ClusterParameter ",
            F.col("name"),
            " ",
            F.col("reason"),
        ).alias("command"),
    )
    n = len(rules)
    restarts = [("Stop-ClusterResource", "resource"), ("Start-ClusterResource", "resource"),
                ("Start-Clustergroup", "owner_group")]
    follow = F.array(
        *[
            F.struct(
                F.lit(n + i + 1).alias("step"),
                concat_text(f"{verb} '", F.col(target), "'").alias("command"),
            )
            for i, (verb, target) in enumerate(restarts)
        ]
    )
    after = drifted.select(*keys, "resource", "owner_group").distinct().select(
        *keys, "resource", F.inline(follow)
    )
    return fixes.unionByName(after)


def option_state_drift(options: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Options whose actual state differs from the desired one."""
    return options.filter(
        ~F.col("desired_state_desc").eqNullSafe(F.col("actual_state_desc"))
    ).select(*keys, "name", "desired_state_desc", "actual_state_desc", "reason_desc")


def orphaned_users(
    db_principals: DataFrame, server_principals: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Database users whose login of the same name has another SID, with a repair statement."""
    logins = server_principals.select(
        *keys, F.lower("name").alias("_fold"), F.col("sid").alias("_login_sid")
    )
    users = db_principals.filter(
        F.col("type").isin(*USER_TYPES)
        & ~F.lower("name").isin(*[n.lower() for n in SYSTEM_USERS])
    ).withColumn("_fold", F.lower("name"))
    return (
        users.join(logins, [*keys, "_fold"])
        .filter(F.col("sid") != F.col("_login_sid"))
        .select(
            *db_principals.columns,
            _repair_user().alias("statement"),
        )
    )


def _repair_user() -> Column:
    return concat_text("ALTER USER [", F.col("name"), "] WITH LOGIN = [", F.col("name"), "]")


def _grant(target: Column | None, grantee: Column) -> Column:
    """A guarded GRANT or DENY text for the current permission row."""
    with_option = F.col("state") == "W"
    parts = [
        "IF DATABASE_PRINCIPAL_ID(",
        quote_name("grantee", "'"),
        ") IS NOT NULL ",
        F.when(with_option, F.lit("GRANT")).otherwise(F.col("state_desc")),
        " ",
        F.col("permission_name"),
        " ",
    ]
    if target is not None:
        parts += ["ON ", target, " "]
    parts += [
        "TO ",
        grantee,
        F.when(with_option, " WITH GRANT OPTION").otherwise(F.lit("")),
    ]
    return concat_text(*parts)


def permission_statements(
    principals: DataFrame,
    members: DataFrame,
    permissions: DataFrame,
    columns: DataFrame,
    objects: DataFrame,
    types: DataFrame,
    schemas: DataFrame,
    server_principals: DataFrame,
    databases: DataFrame,
    keys: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """The statements that recreate a database's users, roles and permissions, in sections.

    ``keys`` must identify a database when there is more than one; ``databases`` holds the keys and
    ``database_name``.  Result: keys, ``statement``, ``result_order`` (``DECIMAL(4,1)``).
    """
    k = list(keys)

    # The headings of the sections and their places.
    header_texts = [
        ("1.0", F.lit("-- [-- DB CONTEXT --] --")),
        ("1.1", concat_text("USE ", quote_name("database_name"))),
        ("2.0", F.lit("")),
        ("3.0", F.lit("-- [-- DB USERS --] --")),
        ("4.0", F.lit("-- [-- ORPHANED USERS --] --")),
        ("5.0", F.lit("-- [-- DB ROLES --] --")),
        ("7.0", F.lit("")),
        ("7.1", F.lit("-- [-- OBJECT LEVEL PERMISSIONS --] --")),
        ("8.0", F.lit("-- [-- TYPE LEVEL PERMISSIONS --] --")),
        ("9.0", F.lit("")),
        ("10.0", F.lit("-- [--DB LEVEL PERMISSIONS --] --")),
        ("11.0", F.lit("")),
        ("12.0", F.lit("-- [--DB LEVEL SCHEMA PERMISSIONS --] --")),
    ]
    headers = databases.select(
        *k,
        F.inline(
            F.array(
                *[
                    F.struct(
                        text.alias("statement"),
                        F.lit(order).cast("decimal(4,1)").alias("result_order"),
                    )
                    for order, text in header_texts
                ]
            )
        ),
    )

    sections = [
        headers,
        _principal_rows(principals, server_principals, k),
        _membership_rows(principals, members, k),
        _permission_rows(principals, permissions, columns, objects, types, schemas, databases, k),
    ]
    out = reduce(DataFrame.unionByName, sections).distinct()
    return out.orderBy(*k, "result_order", "statement") if ordered else out


def _line(order: str, statement: Column, when: Column) -> Column:
    """A line of a section, or NULL."""
    place = F.lit(order).cast("decimal(4,1)").alias("result_order")
    return F.when(when, F.struct(statement.alias("statement"), place))


def _lines(df: DataFrame, keys: Sequence[str], *lines: Column) -> DataFrame:
    """The lines that each row gives, in one pass."""
    return df.select(*keys, F.inline(F.array_compact(F.array(*lines))))


def _principal_rows(principals: DataFrame, logins: DataFrame, keys: list[str]) -> DataFrame:
    """Users, repairs of orphaned users, and roles: what a principal gives by itself."""
    # One row per name, however many logins share it: another SID is one beside the least or greatest.
    found = logins.groupBy(
        *[F.col(c).alias(f"_l_{c}") for c in keys], F.lower("name").alias("_l_fold")
    ).agg(F.min("sid").alias("_l_least"), F.max("sid").alias("_l_greatest"))
    is_person = F.col("type").isin(*USER_TYPES)
    folded = F.lower("name")
    orphan = all_of(
        *[F.col(c) == F.col(f"_l_{c}") for c in keys],
        folded == F.col("_l_fold"),
        (F.col("sid") != F.col("_l_least")) | (F.col("sid") != F.col("_l_greatest")),
        is_person & ~folded.isin(*[n.lower() for n in SYSTEM_USERS]),
    )
    create = _create_user()
    is_role = (F.col("type") == "R") & ~F.col("is_fixed_role")
    role = concat_text(
        "IF DATABASE_PRINCIPAL_ID(", quote_name("name", "'"), ") IS NULL CREATE ROLE ", quote_name("name")
    )
    return _lines(
        principals.join(sized_for_join(found), orphan, "left"),
        keys,
        _line("3.1", create, is_person & ~folded.isin("guest", "dbo") & create.isNotNull()),
        _line("4.1", _repair_user(), F.col("_l_fold").isNotNull()),
        _line("5.1", role, is_role),
    )


def _membership_rows(principals: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    people = principals.filter(
        F.col("type").isin(*USER_TYPES) & (F.col("principal_id") > LAST_FIXED_PRINCIPAL)
    )
    member_names = people.select(
        *keys, F.col("principal_id").alias("member_principal_id"), F.col("name").alias("_member")
    )
    role_names = principals.select(
        *keys, F.col("principal_id").alias("role_principal_id"), F.col("name").alias("_role")
    )
    named = members.join(sized_for_join(member_names), [*keys, "member_principal_id"]).join(
        sized_for_join(role_names), [*keys, "role_principal_id"], "left"
    )
    statement = concat_text(
        "IF DATABASE_PRINCIPAL_ID(",
        quote_name("_member", "'"),
        ") IS NOT NULL EXEC sp_addrolemember @rolename = ",
        quote_name("_role", "'"),
        ", @membername = ",
        quote_name("_member", "'"),
    )
    return _lines(named, keys, _line("5.2", statement, F.lit(True)))


def _permission_rows(
    principals: DataFrame,
    permissions: DataFrame,
    columns: DataFrame,
    objects: DataFrame,
    types: DataFrame,
    schemas: DataFrame,
    databases: DataFrame,
    keys: list[str],
) -> DataFrame:
    """The lines of all permissions, from one scan of every table.

    A permission meets its grantee, and what its ``major_id`` may be, once; each section it belongs
    to is a copy of the row, and the copies that need a schema's name look it up together.
    """
    names = principals.select(
        *keys,
        F.col("principal_id").alias("grantee_principal_id"),
        F.col("name").alias("grantee"),
        F.col("type").alias("_grantee_type"),
    )
    object_names = objects.select(
        *keys,
        F.col("object_id").alias("major_id"),
        F.col("name").alias("_object"),
        F.col("schema_name").alias("_object_schema"),
        F.col("type").alias("_object_type"),
    )
    column_names = columns.select(
        *keys,
        F.col("object_id").alias("major_id"),
        F.col("column_id").alias("minor_id"),
        F.col("name").alias("_column"),
    )
    type_names = types.select(
        *keys,
        F.col("user_type_id").alias("major_id"),
        F.col("name").alias("_type_name"),
        F.col("schema_id").alias("_type_schema"),
        F.lit(True).alias("_is_type"),
    )
    granted = permissions.join(sized_for_join(names), [*keys, "grantee_principal_id"])
    if keys:
        # A permission of an unlisted database has no object section, but its other ones.
        listed = databases.select(*keys, "database_name", F.lit(True).alias("_listed"))
        located = granted.join(sized_for_join(listed), keys, "left")
    else:
        located = granted.withColumns(
            {"database_name": databases.select("database_name").scalar(), "_listed": F.lit(True)}
        )
    met = (
        located.join(sized_for_join(object_names), [*keys, "major_id"], "left")
        .join(sized_for_join(column_names), [*keys, "major_id", "minor_id"], "left")
        .join(sized_for_join(type_names), [*keys, "major_id"], "left")
    )
    is_master = F.lower("database_name") == "master"
    on_object = F.col("_listed") & (
        is_master | (F.col("_object_type").isNotNull() & (F.trim("_object_type") != "S"))
    )
    on_database = (
        (F.col("major_id") == 0)
        & (F.col("grantee_principal_id") > LAST_FIXED_PRINCIPAL)
        & F.col("_grantee_type").isin(*USER_TYPES, "R")
    )

    def copy(order: str, when: Column, schema: Column) -> Column:
        return F.when(when, F.struct(F.lit(order).alias("_order"), schema.alias("_schema_id")))

    id_type = schemas.schema["schema_id"].dataType
    none = F.lit(None).cast(id_type)
    copies = F.array_compact(
        F.array(
            copy("7.2", on_object, none),
            copy("8.1", F.col("_is_type"), F.col("_type_schema")),
            copy("10.1", on_database, none),
            copy("12.1", F.col("class") == 3, F.col("major_id").cast(id_type)),
        )
    )
    schema_names = schemas.select(*keys, F.col("schema_id").alias("_schema_id"), F.col("name").alias("_schema"))
    placed = met.select("*", F.inline(copies)).join(
        sized_for_join(schema_names), [*keys, "_schema_id"], "left"
    )
    column_part = F.when(F.col("_column").isNull(), F.lit("")).otherwise(
        concat_text("(", quote_name("_column"), ")")
    )
    on = {
        "7.2": concat_text(quote_name("_object_schema"), ".", quote_name("_object"), column_part),
        "8.1": concat_text(quote_name("_schema"), ".", quote_name("_type_name")),
        "12.1": concat_text(F.col("class_desc"), "::", quote_name("_schema")),
    }
    lines = [
        _line(order, _grant(target, quote_name("grantee")), F.col("_order") == order)
        for order, target in on.items()
    ]
    plain = _grant(None, concat_text("[", F.col("grantee"), "]"))
    lines.append(_line("10.1", plain, F.col("_order") == "10.1"))
    # A schema permission without its schema says nothing.
    known = placed.filter((F.col("_order") != "12.1") | F.col("_schema").isNotNull())
    return _lines(known, keys, *lines)


def _create_user() -> Column:
    """A guarded CREATE USER text for a principal row."""
    guard = concat_text(
        "IF NOT EXISTS (SELECT [name] FROM sys.database_principals WHERE [name] =  '",
        F.col("name"),
        "') BEGIN CREATE USER  ",
        quote_name("name"),
    )
    without_login = concat_text(
        guard,
        " WITHOUT LOGIN WITH DEFAULT_SCHEMA = ",
        quote_name("default_schema_name"),
        " , SID = ",
        concat_text("0x", F.hex("sid")),
        "  END; ",
    )
    default_schema = F.when(
        F.col("type") != "G",
        concat_text(
            " WITH DEFAULT_SCHEMA = ",
            quote_name(F.coalesce("default_schema_name", F.lit("dbo"))),
        ),
    ).otherwise(F.lit(""))
    for_login = concat_text(
        guard, " FOR LOGIN ", quote_name("login_name"), default_schema, " END; "
    )
    return F.when(F.col("authentication_type").isin(2, 0), without_login).otherwise(for_login)


def fleet_inventory(
    servers: DataFrame,
    groups: DataFrame,
    pattern: str,
    on: Sequence[str] = ("server",),
) -> DataFrame:
    """Availability groups of the registered servers whose server group matches ``pattern``.

    ``pattern`` uses ``*`` and is case-insensitive.
    """
    wanted = F.rlike("server_group", like_regex(F.lit(pattern.replace("*", "%"))))
    return (
        servers.filter(wanted)
        .join(groups, list(on))
        .select(*on, "computer_name", "instance_name", "local_replica_role", "listener")
    )


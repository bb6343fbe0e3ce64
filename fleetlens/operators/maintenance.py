"""Index and statistics maintenance: what to look at, what to do, and the command text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import concat_text, quote_name
from fleetlens.operators.distributed import ordered_scan

REORGANIZE = "INDEX_REORGANIZE"
REBUILD_ONLINE = "INDEX_REBUILD_ONLINE"
REBUILD_OFFLINE = "INDEX_REBUILD_OFFLINE"

# Default action preferences per fragmentation group, and default thresholds.
DEFAULT_PREFERENCES = {
    "Low": [],
    "Medium": [REORGANIZE, REBUILD_ONLINE, REBUILD_OFFLINE],
    "High": [REBUILD_ONLINE, REBUILD_OFFLINE],
}
FRAGMENTATION_LEVEL_1 = 5
FRAGMENTATION_LEVEL_2 = 30
MIN_NUMBER_OF_PAGES = 1000

# Index type names by code; editions that rebuild online; cloud editions.
INDEX_TYPES = {
    1: "Clustered",
    2: "NonClustered",
    3: "XML",
    4: "Spatial",
    5: "Clustered Columnstore",
    6: "NonClustered Columnstore",
    7: "NonClustered Hash",
}
OBJECT_TYPES = {"U": "Table", "V": "View"}
ONLINE_EDITIONS = [3, 5, 8]
CLOUD_EDITIONS = [5, 8]

_TARGET_FLAGS = [
    "is_image_text",
    "is_new_lob",
    "is_filestream",
    "is_columnstore",
    "is_computed",
    "is_timestamp",
    "on_read_only_filegroup",
    "resumable_index_operation",
]
_OWNER = ["schema_id", "schema_name", "object_name", "object_type", "is_memory_optimized"]


def partition_level_statistics(version: float, edition: int, partition_level: bool = True) -> bool:
    """Whether the server keeps statistics properties per partition."""
    return partition_level and (
        12.05 <= version < 13 or version >= 13.04422 or edition in CLOUD_EDITIONS
    )


def _any(condition: Column, name: str) -> Column:
    return F.bool_or(F.coalesce(condition, F.lit(False))).alias(name)


def _columns_with_facts(catalog: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Columns with what follows from their types, in one pass over them.

    A type is looked up by the column's system type, by its own type where that is an assembly
    type, and by the family of its system type; each lookup has one row per id.
    """
    by_own_id = catalog["types"].groupBy(*keys, "user_type_id").agg(
        F.max("name").alias("name"), _any(F.col("is_assembly_type"), "is_assembly")
    )
    families = catalog["types"].groupBy(*keys, "system_type_id").agg(
        _any(F.col("name") == "timestamp", "_stamp")
    )

    def named(prefix: str, column: str) -> DataFrame:
        return by_own_id.select(
            *keys,
            F.col("user_type_id").alias(column),
            F.col("name").alias(f"{prefix}_name"),
            F.col("is_assembly").alias(f"{prefix}_assembly"),
        )

    def is_lob(prefix: str) -> Column:
        unlimited = F.col("max_length") == -1
        name = F.col(f"{prefix}_name")
        return (
            (name == "xml")
            | (name.isin("varchar", "nvarchar", "varbinary") & unlimited)
            | (F.col(f"{prefix}_assembly") & unlimited)
        )

    typed = (
        catalog["columns"]
        .join(named("_base", "system_type_id"), [*keys, "system_type_id"], "left")
        .join(named("_own", "user_type_id").filter("_own_assembly"), [*keys, "user_type_id"], "left")
        .join(families, [*keys, "system_type_id"], "left")
    )
    facts = {
        "image": F.col("_base_name").isin("image", "text", "ntext"),
        "lob": F.coalesce(is_lob("_base"), F.lit(False)) | F.coalesce(is_lob("_own"), F.lit(False)),
        "stamp": F.col("_stamp"),
    }
    return typed.select(
        *keys, "object_id", "column_id", "is_filestream", "is_computed",
        *[F.coalesce(c, F.lit(False)).alias(n) for n, c in facts.items()],
    )


def _read_only_groups(catalog: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    return catalog["filegroups"].filter("is_read_only").select(*keys, "data_space_id").distinct()


def _object_facts(
    catalog: Mapping[str, DataFrame], keys: Sequence[str], columns: DataFrame, ms_shipped: bool
) -> DataFrame:
    """Tables and views with their names and object-level flags: one row per object."""
    k, obj = list(keys), [*keys, "object_id"]
    objects = catalog["objects"].filter(F.trim("type").isin(*OBJECT_TYPES))
    if not ms_shipped:
        objects = objects.filter(~F.col("is_ms_shipped"))
    flags = columns.groupBy(*obj).agg(
        _any(F.col("image"), "_image"),
        _any(F.col("lob"), "_object_lob"),
        _any(F.col("is_filestream"), "_filestream"),
    )
    columnstore = catalog["indexes"].groupBy(*obj).agg(_any(F.col("type").isin(5, 6), "_column"))
    lob_spaces = _read_only_groups(catalog, k).select(
        *k, F.col("data_space_id").alias("lob_data_space_id"), F.lit(True).alias("_lob_ro")
    )
    tables = catalog["tables"].select(*obj, "is_memory_optimized", "lob_data_space_id")
    return (
        objects.select(*obj, "schema_id", F.col("name").alias("object_name"),
                       F.rtrim("type").alias("object_type"))
        .join(tables, obj, "left")
        .join(flags, obj, "left")
        .join(columnstore, obj, "left")
        .join(catalog["schemas"].select(*k, "schema_id", F.col("name").alias("schema_name")),
              [*k, "schema_id"])
        .join(lob_spaces, [*k, "lob_data_space_id"], "left")
        .drop("lob_data_space_id")
    )


def _index_rows(
    catalog: Mapping[str, DataFrame],
    keys: Sequence[str],
    columns: DataFrame,
    objects: DataFrame,
    partition_level: bool,
) -> DataFrame:
    """Indexes per partition.  Joins on the index come first, the one on the object last, so the
    rows are repartitioned once for each."""
    k = list(keys)
    idx, obj = [*k, "object_id", "index_id"], [*k, "object_id"]
    in_key = (F.col("key_ordinal") > 0) | (F.col("partition_ordinal") > 0)
    per_index = (
        catalog["index_columns"]
        .join(columns, [*obj, "column_id"])
        .groupBy(*idx)
        .agg(
            _any(F.col("lob"), "_index_lob"),
            _any(in_key & F.col("is_computed"), "_computed"),
            _any(F.col("stamp"), "_stamp"),
        )
    )
    read_only = _read_only_groups(catalog, k)
    spread_by = ["partition_number"] if partition_level else []
    spread = (
        catalog["destination_data_spaces"]
        .join(read_only, [*k, "data_space_id"], "left_semi")
        .select(
            *k,
            F.col("partition_scheme_id").alias("data_space_id"),
            F.col("destination_id").alias("partition_number"),
        )
        .select(*k, "data_space_id", *spread_by)
        .distinct()
        .withColumn("_spread_ro", F.lit(True))
    )
    # An index has few partitions, so the paused ones travel as a set.
    paused = (
        catalog["resumable_operations"]
        .filter("state_desc = 'PAUSED'")
        .groupBy(*idx)
        .agg(
            _any(F.col("partition_number").isNull(), "_paused_all"),
            F.collect_set("partition_number").alias("_paused_parts"),
        )
    )
    stats = catalog["stats"].select(
        *obj,
        F.col("stats_id").alias("index_id"),
        F.col("stats_id").alias("statistics_id"),
        F.col("name").alias("statistics_name"),
        "no_recompute",
        "is_incremental",
    )
    rows = (
        catalog["indexes"]
        .filter("type between 1 and 7 and not is_disabled and not is_hypothetical")
        .select(
            *idx,
            F.col("name").alias("index_name"),
            F.col("type").alias("index_type"),
            "allow_page_locks",
            "data_space_id",
        )
        .dropDuplicates(idx)
        .join(stats.dropDuplicates(idx), idx, "left")
        .join(per_index, idx, "left")
        .join(paused, idx, "left")
    )
    if partition_level:
        # An index has a bounded number of partitions, so they travel with it as a set.
        # Their number is taken from the set: a distinct count beside it would shuffle every row twice.
        parts = catalog["partitions"].groupBy(*idx).agg(
            F.collect_set(F.struct("partition_id", "partition_number")).alias("_parts")
        )
        numbers = F.array_distinct(F.array_compact(F.col("_parts.partition_number")))
        parts = parts.withColumn("partition_count", F.size(numbers))
        rows = rows.join(parts, idx, "left").select("*", F.inline_outer("_parts")).drop("_parts")
    else:
        for name, kind in (("partition_id", "bigint"), ("partition_number", "int"),
                           ("partition_count", "int")):
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = (
        rows.join(objects, obj)
        .join(read_only.withColumn("_direct_ro", F.lit(True)), [*k, "data_space_id"], "left")
        .join(spread, [*k, "data_space_id", *spread_by], "left")
    )
    clustered, nonclustered = F.col("index_type") == 1, F.col("index_type") == 2
    paused_here = F.array_contains("_paused_parts", F.col("partition_number"))
    if not partition_level:
        paused_here = F.size("_paused_parts") > 0
    flags = {
        "is_image_text": clustered & F.col("_image"),
        "is_new_lob": (clustered & F.col("_object_lob")) | (nonclustered & F.col("_index_lob")),
        "is_filestream": clustered & F.col("_filestream"),
        "is_columnstore": F.col("_column"),
        "is_computed": F.col("_computed"),
        "is_timestamp": F.col("_stamp"),
        "on_read_only_filegroup": F.coalesce("_spread_ro", F.lit(False))
        | F.coalesce("_direct_ro", F.lit(False))
        | (clustered & F.coalesce("_lob_ro", F.lit(False))),
        "resumable_index_operation": F.col("_paused_all") | F.coalesce(paused_here, F.lit(False)),
    }
    out = rows.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    return out.select(
        *idx, "index_name", "index_type", "allow_page_locks", *_TARGET_FLAGS, "statistics_id",
        "statistics_name", "no_recompute", "is_incremental", "partition_id", "partition_number",
        "partition_count", *_OWNER,
    )


def _statistics_rows(
    catalog: Mapping[str, DataFrame],
    keys: Sequence[str],
    objects: DataFrame,
    per_partition: bool,
) -> DataFrame:
    """Statistics that belong to no index."""
    obj = [*keys, "object_id"]
    indexed = catalog["indexes"].select(*obj, F.col("index_id").alias("stats_id"))
    known = catalog["stats"].dropDuplicates([*obj, "stats_id"])
    alone = known.join(indexed, [*obj, "stats_id"], "left_anti")
    if per_partition:
        parts = catalog["incremental_stats"].select(*obj, "stats_id", "partition_number").distinct()
        alone = alone.join(parts, [*obj, "stats_id"], "left")
    else:
        alone = alone.withColumn("partition_number", F.lit(None).cast("int"))
    nothing = {n: F.lit(None).cast("boolean") for n in ["allow_page_locks", *_TARGET_FLAGS]}
    owners = objects.select(*obj, *_OWNER)
    return alone.join(owners, obj).select(
        *obj,
        F.lit(None).cast("int").alias("index_id"),
        F.lit(None).cast("string").alias("index_name"),
        F.lit(None).cast("int").alias("index_type"),
        *[c.alias(n) for n, c in nothing.items()],
        F.col("stats_id").alias("statistics_id"),
        F.col("name").alias("statistics_name"),
        "no_recompute",
        "is_incremental",
        F.lit(None).cast("bigint").alias("partition_id"),
        "partition_number",
        F.lit(None).cast("int").alias("partition_count"),
        *_OWNER,
    )


def index_stat_targets(
    catalog: Mapping[str, DataFrame],
    keys: Sequence[str] = (),
    actions: bool = True,
    update_statistics: str | None = None,
    partition_level: bool = True,
    incremental_partitions: bool = False,
    ms_shipped: bool = False,
) -> DataFrame:
    """Indexes (per partition) and column statistics that maintenance may treat.

    ``catalog`` maps ``indexes objects schemas tables stats partitions columns types index_columns
    filegroups destination_data_spaces resumable_operations`` (and ``incremental_stats`` with
    ``incremental_partitions``) to catalog tables.  ``update_statistics`` is ``ALL``, ``INDEX``,
    ``COLUMNS`` or None.  Existence tests are one aggregated flag table per grain, joined once.
    Catalog rows that were landed twice count once: they are told apart by their ids, before the
    joins, where a join on these ids follows anyway.
    """
    k = list(keys)
    columns = _columns_with_facts(catalog, k)
    objects = _object_facts(catalog, k, columns, ms_shipped)
    branches = []
    if actions or update_statistics in ("ALL", "INDEX"):
        branches.append(_index_rows(catalog, k, columns, objects, partition_level))
    if update_statistics in ("ALL", "COLUMNS"):
        branches.append(_statistics_rows(catalog, k, objects, incremental_partitions))
    if not branches:
        raise ValueError("nothing to do: no actions and no statistics")
    return reduce(DataFrame.unionByName, branches)


def order_targets(
    targets: DataFrame, keys: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Selected targets with ``item_order``: paused operations first, then list position and names.

    ``bounded`` as in :func:`~fleetlens.operators.distributed.ordered_scan`.
    """
    order = [
        ("_paused", True),
        "start_position",
        "schema_name",
        "object_name",
        "_no_index",
        "index_type",
        "index_name",
        "statistics_name",
        "partition_number",
        "object_id",
    ]
    ready = targets.filter("selected").withColumns(
        {
            "_paused": F.coalesce("resumable_index_operation", F.lit(False)),
            "_no_index": F.col("index_type").isNull(),
        }
    )
    ordered = ordered_scan(ready, keys, order, position="item_order", bounded=bounded)
    return ordered.drop("_paused", "_no_index")


def fragmentation(
    physical_stats: DataFrame, keys: Sequence[str] = (), partition_level: bool = True
) -> DataFrame:
    """Greatest fragmentation and page count of the leaf level per index (and partition)."""
    leaf = physical_stats.filter("alloc_unit_type_desc = 'IN_ROW_DATA' and index_level = 0")
    part = ["partition_number"] if partition_level else []
    return leaf.groupBy(*keys, "object_id", "index_id", *part).agg(
        F.max("avg_fragmentation_in_percent").alias("fragmentation_level"),
        F.sum("page_count").alias("page_count"),
    )


def fragmentation_group(
    level: Column, l1: float = FRAGMENTATION_LEVEL_1, l2: float = FRAGMENTATION_LEVEL_2
) -> Column:
    """``Low`` below ``l1``, ``High`` from ``l2``, ``Medium`` between; NULL stays NULL."""
    return F.when(level >= l2, "High").when(level >= l1, "Medium").when(level < l1, "Low")


def is_partition() -> Column:
    """Whether a target is one of several partitions."""
    return F.col("partition_number").isNotNull() & ~F.coalesce(
        F.col("partition_count") == 1, F.lit(False)
    )


def allowed_actions(targets: DataFrame, version: float = 15.0, edition: int = 3) -> DataFrame:
    """Targets with the array of actions their index permits."""
    kind = F.col("index_type")
    writable = (F.col("on_read_only_filegroup") == False) & ~F.coalesce(  # noqa: E712
        F.col("is_memory_optimized"), F.lit(False)
    )
    treatable = writable & kind.isin(1, 2, 3, 4, 5)
    image, lob = F.col("is_image_text"), F.col("is_new_lob")
    movable = ((kind == 1) & ~image & ~lob) | ((kind == 2) & ~lob)
    if version >= 11:
        movable = movable | ((kind == 1) & ~image & ~F.col("is_filestream")) | (kind == 2)
    online = writable & movable & F.lit(edition in ONLINE_EDITIONS)
    if version < 12:
        online = online & ~is_partition()
    if version >= 11:
        online = online & ~F.col("is_columnstore")
    actions = F.array_compact(
        F.array(
            F.when(treatable & (F.col("allow_page_locks") | (kind == 5)), REORGANIZE),
            F.when(treatable, REBUILD_OFFLINE),
            F.when(online, REBUILD_ONLINE),
        )
    )
    none = F.array().cast("array<string>")
    return targets.withColumn(
        "allowed_actions", F.when(F.col("index_id").isNotNull(), actions).otherwise(none)
    )


def _preferred(preference: Sequence[str]) -> Column:
    """The first preferred action that is allowed."""
    if not preference:
        return F.lit(None).cast("string")
    wished = F.array(*[F.lit(a) for a in preference])
    return F.get(F.array_intersect(wished, "allowed_actions"), F.lit(0))


def choose_action(
    targets: DataFrame,
    preferences: Mapping[str, Sequence[str]] = DEFAULT_PREFERENCES,
    min_pages: int = MIN_NUMBER_OF_PAGES,
    max_pages: int | None = None,
    l1: float = FRAGMENTATION_LEVEL_1,
    l2: float = FRAGMENTATION_LEVEL_2,
) -> DataFrame:
    """Targets with ``fragmentation_group`` and ``action``.

    The action is the most preferred allowed one for the fragmentation group, if the page count is
    within bounds.  With the same preferences for all groups the group does not matter.  A paused
    resumable operation is always continued.  Needs ``allowed_actions`` (:func:`allowed_actions`),
    ``fragmentation_level`` and ``page_count`` (:func:`fragmentation`).
    """
    lists = [list(preferences.get(g) or []) for g in ("Low", "Medium", "High")]
    planned = any(lists)
    measurable = F.col("index_id").isNotNull() & (F.col("on_read_only_filegroup") == False)  # noqa: E712
    group = F.when(measurable, fragmentation_group(F.col("fragmentation_level"), l1, l2))
    if not planned:
        wanted, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    elif lists[0] == lists[1] == lists[2]:
        wanted = _preferred(lists[0])
    else:
        wanted = reduce(
            lambda c, g: c.when(F.col("fragmentation_group") == g[0], _preferred(g[1])),
            list(zip(("Medium", "High"), lists[1:])),
            F.when(F.col("fragmentation_group") == "Low", _preferred(lists[0])),
        )
    pages = F.col("page_count")
    in_bounds = F.lit(True) if min_pages == 0 else pages >= min_pages
    if max_pages is not None:
        in_bounds = in_bounds & (pages <= max_pages)
    paused = F.coalesce("resumable_index_operation", F.lit(False))
    not_paused = F.col("resumable_index_operation") == False  # noqa: E712
    action = F.when(paused, REBUILD_ONLINE).when(
        F.col("index_id").isNotNull() & in_bounds & not_paused, wanted
    )
    return targets.withColumn("fragmentation_group", group).withColumn("action", action)


def stats_update_decision(
    targets: DataFrame,
    mode: str | None = "ALL",
    only_modified: bool = False,
    level: int | None = None,
    per_partition: bool = False,
    version: float = 15.0,
    edition: int = 3,
) -> DataFrame:
    """Targets with ``update_statistics``: whether to refresh their statistics.

    ``mode`` is ``ALL``, ``INDEX``, ``COLUMNS`` or None.  Modified means a positive modification
    counter (``only_modified``), or with ``level`` a modified share of at least ``level`` percent or
    at least ``sqrt(1000 * rows)`` modifications.  Statistics of a rebuilt index are fresh.  Of a
    partitioned index only the last partition counts, unless statistics are kept per partition.
    """
    is_index = F.col("index_id").isNotNull()
    supported = F.col("index_type").isin(1, 2, 3, 4, 7)
    scope = {
        "ALL": supported | ~is_index,
        "INDEX": is_index & supported,
        "COLUMNS": ~is_index,
        None: F.lit(False),
    }[mode]
    counter, rows = F.col("modification_counter"), F.col("row_count")
    modified = F.lit(not only_modified and level is None)
    if only_modified:
        modified = modified | (counter > 0)
    if level is not None:
        share = counter.cast("decimal(38,0)") * 100 >= F.lit(level) * F.nullif(rows, F.lit(0))
        # counter >= sqrt(1000 * rows), squared to stay on integers.
        square = counter.cast("decimal(19,0)") * counter.cast("decimal(19,0)")
        modified = modified | share | ((counter > 0) & (square >= rows.cast("decimal(38,0)") * 1000))
    if not (version >= 13 or edition in CLOUD_EDITIONS):
        modified = modified | F.col("is_memory_optimized")
    rebuilt = F.col("action").isin(REBUILD_ONLINE, REBUILD_OFFLINE)
    partition = is_partition()
    last = F.col("partition_number") == F.col("partition_count")
    if per_partition:
        last = last | F.col("is_incremental")
    due = (~partition & (~rebuilt | F.col("action").isNull())) | (partition & last)
    decision = F.col("statistics_id").isNotNull() & scope & modified & due
    return targets.withColumn("update_statistics", F.coalesce(decision, F.lit(False)))


def _yes_no(flag: str) -> Column:
    return F.when(F.col(flag), "Yes").when(~F.col(flag), "No").otherwise("N/A")


def _label(code: str, names: Mapping) -> Column:
    out = F.lit("N/A")
    for value, text in names.items():
        out = F.when(F.col(code) == value, text).otherwise(out)
    return out


def _or_na(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def _comment(*fields: tuple[str, Column]) -> Column:
    return F.concat_ws(", ", *[concat_text(f"{name}: ", value) for name, value in fields])


def _options(*options: Column) -> Column:
    return F.array_compact(F.array(*options))


def index_command(
    targets: DataFrame,
    version: float = 15.0,
    edition: int = 3,
    sort_in_tempdb: bool = False,
    max_dop: int | None = None,
    fill_factor: int | None = None,
    pad_index: bool = False,
    lob_compaction: bool = True,
    resumable: bool = False,
    max_duration_minutes: int | None = None,
    low_priority_minutes: int | None = None,
    low_priority_abort: str | None = None,
    lock_timeout_s: int | None = None,
) -> DataFrame:
    """Targets with the ``index_command`` text of their action and an ``index_comment``.

    The command is NULL without an action.  Nothing is executed.
    """
    action, kind = F.col("action"), F.col("index_type")
    paused = F.coalesce("resumable_index_operation", F.lit(False))
    rebuild = action.isin(REBUILD_ONLINE, REBUILD_OFFLINE)
    online, offline = action == REBUILD_ONLINE, action == REBUILD_OFFLINE
    reorganize = action == REORGANIZE
    fresh, whole = ~paused, ~is_partition()
    rowstore = kind.isin(1, 2, 3, 4)
    modern = version >= 14 or edition in CLOUD_EDITIONS
    can_resume = kind.isin(1, 2) & ~F.col("is_computed") & ~F.col("is_timestamp")

    wait = ""
    if low_priority_minutes is not None:
        wait = (
            f" (WAIT_AT_LOW_PRIORITY (MAX_DURATION = {low_priority_minutes}, "
            f"ABORT_AFTER_WAIT = {str(low_priority_abort).upper()}))"
        )
    switchable = fresh if version >= 12 else fresh & whole
    # An online rebuild without page locks must not run in parallel.
    dop = F.when(online & ~F.col("allow_page_locks"), F.lit("1")).otherwise(
        F.lit(None if max_dop is None else str(max_dop)).cast("string")
    )
    options = [
        F.when(
            rebuild & rowstore & fresh, f"SORT_IN_TEMPDB = {'ON' if sort_in_tempdb else 'OFF'}"
        ),
        F.when(online & switchable, "ONLINE = ON" + wait),
        F.when(offline & switchable, "ONLINE = OFF"),
        F.when(rebuild, concat_text("MAXDOP = ", dop)),
    ]
    if fill_factor is not None:
        options.append(F.when(rebuild & whole & rowstore & fresh, f"FILLFACTOR = {fill_factor}"))
    if pad_index:
        options.append(F.when(rebuild & whole & rowstore & fresh, "PAD_INDEX = ON"))
    if modern:
        wanted = can_resume & F.lit(resumable)
        options.append(
            F.when(
                online & fresh,
                F.when(wanted, "RESUMABLE = ON").otherwise("RESUMABLE = OFF"),
            )
        )
        if resumable and max_duration_minutes is not None:
            options.append(
                F.when(online & fresh & can_resume, f"MAX_DURATION = {max_duration_minutes}")
            )
    options.append(F.when(reorganize, f"LOB_COMPACTION = {'ON' if lob_compaction else 'OFF'}"))

    with_clause = F.array_join(_options(*options), ", ")
    verb = (
        F.when(paused, " RESUME").when(rebuild, " REBUILD").when(reorganize, " REORGANIZE")
    )
    timeout = "" if lock_timeout_s is None else f"SET LOCK_TIMEOUT {lock_timeout_s * 1000}; "
    command = concat_text(
        timeout + "ALTER INDEX ",
        quote_name("index_name"),
        " ON ",
        quote_name("schema_name"),
        ".",
        quote_name("object_name"),
        verb,
        F.when(
            is_partition() & fresh,
            concat_text(" PARTITION = ", F.col("partition_number").cast("string")),
        ).otherwise(F.lit("")),
        F.when(with_clause != "", concat_text(" WITH (", with_clause, ")")).otherwise(F.lit("")),
    )
    fields = [
        ("ObjectType", _label("object_type", OBJECT_TYPES)),
        ("IndexType", _label("index_type", INDEX_TYPES)),
        ("ImageText", _yes_no("is_image_text")),
        ("NewLOB", _yes_no("is_new_lob")),
        ("FileStream", _yes_no("is_filestream")),
    ]
    if version >= 11:
        fields.append(("ColumnStore", _yes_no("is_columnstore")))
    if version >= 14 and resumable:
        fields.append(("Computed", _yes_no("is_computed")))
        fields.append(("Timestamp", _yes_no("is_timestamp")))
    fields += [
        ("AllowPageLocks", _yes_no("allow_page_locks")),
        ("PageCount", _or_na(F.col("page_count"))),
        ("Fragmentation", _or_na(F.col("fragmentation_level"))),
    ]
    is_index = F.col("index_id").isNotNull()
    return targets.withColumns(
        {
            "index_command": F.when(is_index & action.isNotNull(), command),
            "index_comment": F.when(is_index, _comment(*fields)),
        }
    )


def statistics_command(
    targets: DataFrame,
    version: float = 15.0,
    edition: int = 3,
    max_dop: int | None = None,
    sample: int | None = None,
    resample: bool = False,
    per_partition: bool = False,
    lock_timeout_s: int | None = None,
) -> DataFrame:
    """Targets with the ``statistics_command`` text and a ``statistics_comment``.

    The command is NULL where :func:`stats_update_decision` says no.  Incremental statistics, and
    memory-optimized tables on old versions, are always resampled.
    """
    incremental = F.col("is_incremental") & F.lit(per_partition)
    forced = F.coalesce(incremental, F.lit(False))
    if not (version >= 13 or edition in CLOUD_EDITIONS) and sample != 100:
        forced = forced | F.coalesce("is_memory_optimized", F.lit(False))
    dop_known = 12.06024 <= version < 13 or 13.05026 <= version < 14 or version >= 14.030154
    options = []
    if max_dop is not None and dop_known:
        options.append(F.lit(f"MAXDOP = {max_dop}"))
    if sample is not None:
        text = "FULLSCAN" if sample == 100 else f"SAMPLE {sample} PERCENT"
        options.append(F.when(~forced, text))
    options.append(F.when(forced | F.lit(resample), "RESAMPLE"))
    options.append(F.when(F.col("no_recompute"), "NORECOMPUTE"))
    with_clause = F.array_join(_options(*options), ", ")
    timeout = "" if lock_timeout_s is None else f"SET LOCK_TIMEOUT {lock_timeout_s * 1000}; "
    command = concat_text(
        timeout + "UPDATE STATISTICS ",
        quote_name("schema_name"),
        ".",
        quote_name("object_name"),
        " ",
        quote_name("statistics_name"),
        F.when(with_clause != "", concat_text(" WITH ", with_clause)).otherwise(F.lit("")),
        F.when(
            F.coalesce(incremental, F.lit(False)) & F.col("partition_number").isNotNull(),
            concat_text(" ON PARTITIONS(", F.col("partition_number").cast("string"), ")"),
        ).otherwise(F.lit("")),
    )
    is_index = F.col("index_id").isNotNull()
    y_n = F.when(F.col("is_incremental"), "Y").when(~F.col("is_incremental"), "N").otherwise("N/A")
    comment = F.concat_ws(
        ", ",
        concat_text("ObjectType: ", _label("object_type", OBJECT_TYPES)),
        concat_text("IndexType: ", F.when(is_index, "Index").otherwise("Column")),
        F.when(is_index, concat_text("IndexType: ", _label("index_type", INDEX_TYPES))),
        concat_text("Incremental: ", y_n),
        concat_text("RowCount: ", _or_na(F.col("row_count"))),
        concat_text("ModificationCounter: ", _or_na(F.col("modification_counter"))),
    )
    has_statistics = F.col("statistics_id").isNotNull()
    return targets.withColumns(
        {
            "statistics_command": F.when(has_statistics & F.col("update_statistics"), command),
            "statistics_comment": F.when(has_statistics, comment),
        }
    )


def extended_info(targets: DataFrame) -> DataFrame:
    """Targets with the XML notes that a command log stores with a command."""

    def element(name: str, value: str) -> Column:
        text = F.col(value).cast("string")
        return F.coalesce(concat_text(f"<{name}>", text, f"</{name}>"), F.lit(""))

    def note(first: tuple[str, str], second: tuple[str, str]) -> Column:
        known = F.col(first[1]).isNotNull() | F.col(second[1]).isNotNull()
        return F.when(
            known,
            concat_text("<ExtendedInfo>", element(*first), element(*second), "</ExtendedInfo>"),
        )

    return targets.withColumns(
        {
            "index_info": F.when(
                F.col("index_id").isNotNull(),
                note(("PageCount", "page_count"), ("Fragmentation", "fragmentation_level")),
            ),
            "statistics_info": F.when(
                F.col("statistics_id").isNotNull(),
                note(
                    ("RowCount", "row_count"), ("ModificationCounter", "modification_counter")
                ),
            ),
        }
    )

"""Selection lists, ordering and reconciliation of work items."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.text import (
    file_system_name,
    has_wildcard,
    like_regex,
    name_parts,
    one_case,
    parse_name,
    quote_name,
)
from fleetlens.operators.distributed import BROADCAST_ROWS, broadcast_if_small, ordered_scan, sized_for_join, stored

# Keywords of selection lists, as keyword -> (pattern, database type, in a group).
DATABASE_KEYWORDS = {
    "ALL_DATABASES": ("%", None, None),
    "SYSTEM_DATABASES": ("%", "S", None),
    "USER_DATABASES": ("%", "U", None),
    "AVAILABILITY_GROUP_DATABASES": ("%", None, True),
}
KEYWORDS = {
    "databases": DATABASE_KEYWORDS,
    "groups": {"ALL_AVAILABILITY_GROUPS": ("%", None, None)},
    "filegroups": {"ALL_FILEGROUPS": ("%.%", None, None)},
    "objects": {"ALL_OBJECTS": ("%.%.%", None, None)},
    "indexes": {"ALL_INDEXES": ("%.%.%.%", None, None)},
}

#: Name columns of a parsed rule, per kind of list.
RULE_PARTS = {
    "databases": ["database_name"],
    "groups": ["group_name"],
    "filegroups": ["database_name", "filegroup_name"],
    "objects": ["database_name", "schema_name", "object_name"],
    "indexes": ["database_name", "schema_name", "object_name", "index_name"],
}

#: Ordering modes: output order -> (column, descending).
ORDER_MODES = {
    "DATABASE_NAME_ASC": ("name", False),
    "DATABASE_NAME_DESC": ("name", True),
    "DATABASE_SIZE_ASC": ("database_size", False),
    "DATABASE_SIZE_DESC": ("database_size", True),
    "LOG_SIZE_SINCE_LAST_LOG_BACKUP_ASC": ("log_size", False),
    "LOG_SIZE_SINCE_LAST_LOG_BACKUP_DESC": ("log_size", True),
    "DATABASE_LAST_GOOD_CHECK_ASC": ("last_good_check", False),
    "DATABASE_LAST_GOOD_CHECK_DESC": ("last_good_check", True),
    "REPLICA_LAST_GOOD_CHECK_ASC": ("last_command_time", False),
    "REPLICA_LAST_GOOD_CHECK_DESC": ("last_command_time", True),
}

#: Literal rule lists up to this length become one expression; the names of longer ones are joined.
#: Both ways compare letters alike (see ``one_case``), so the length does not change the result.
LITERAL_RULES = 500


def split_list(
    df: DataFrame, text: str, delimiter: str = ",", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per item of a delimited list: ``item`` and its 1-based ``start_position``.

    Line breaks are removed, as are blanks around delimiters and at both ends.  A NULL list has no
    items.  Lists are parameters: short texts, one per row.
    """
    pattern = re.escape(delimiter)
    clean = F.trim(
        F.regexp_replace(F.regexp_replace(F.col(text), r"[\r\n]", ""), f" *{pattern} *", delimiter)
    )
    items = df.select(*keep, F.split(clean, pattern).alias("_items"))
    spread = items.select(*keep, "_items", F.posexplode("_items").alias("_i", "item"))
    ahead = F.array_join(F.slice("_items", F.lit(1), F.col("_i")), delimiter)
    position = F.when(F.col("_i") == 0, 1).otherwise(F.length(ahead) + len(delimiter) + 1)
    return spread.select(*keep, "item", position.cast("int").alias("start_position"))


def parse_rules(items: DataFrame, kind: str = "databases", keep: Sequence[str] = ()) -> DataFrame:
    """Selection rules from list items (the output of :func:`split_list`).

    A leading ``-`` excludes.  Keywords become patterns, with a type (``S`` system, ``U`` user) or a
    group condition for databases.  Names are split into the parts of ``kind`` and lose their
    brackets; a name with too many parts gives NULL parts, which match nothing.
    """
    excluded = F.col("item").startswith("-")
    bare = F.when(excluded, F.substring("item", F.lit(2), F.length("item"))).otherwise(
        F.col("item")
    )
    rules = items.select(*keep, bare.alias("_name"), (~excluded).alias("selected"),
                         "start_position")
    pattern, db_type = F.col("_name"), F.lit(None).cast("string")
    group = F.lit(None).cast("boolean")
    for keyword, (expanded, of_type, in_group) in KEYWORDS[kind].items():
        is_keyword = F.upper("_name") == keyword
        pattern = F.when(is_keyword, expanded).otherwise(pattern)
        db_type = F.when(is_keyword, F.lit(of_type).cast("string")).otherwise(db_type)
        group = F.when(is_keyword, F.lit(in_group).cast("boolean")).otherwise(group)
    rules = rules.withColumns({"_pattern": pattern, "_type": db_type, "_group": group})

    parts = RULE_PARTS[kind]
    if len(parts) == 1:
        bracketed = F.col("_pattern").startswith("[") & F.col("_pattern").endswith("]")
        # A whole bracketed name is unwrapped; a bracket class inside a pattern stays.
        names = {parts[0]: F.when(bracketed, parse_name("_pattern", 1)).otherwise(F.col("_pattern"))}
    else:
        rules = rules.withColumn("_parts", name_parts("_pattern"))
        names = _name_parts(parts)
    out = [*keep, *[c.alias(n) for n, c in names.items()]]
    if kind == "databases":
        out += [F.col("_type").alias("database_type"), F.col("_group").alias("availability_group")]
    return rules.select(*out, "start_position", "selected")


def _name_parts(parts: Sequence[str]) -> dict[str, Column]:
    """Parts of a dotted pattern; index patterns may leave out the index."""
    p = {i: F.get("_parts", F.lit(i - 1)) for i in (1, 2, 3, 4)}
    if len(parts) == 2:
        fits = p[4].isNull() & p[3].isNull()
        return {parts[0]: F.when(fits, p[2]), parts[1]: F.when(fits, p[1])}
    if len(parts) == 3:
        return {n: F.when(p[4].isNull(), p[3 - i]) for i, n in enumerate(parts)}
    short = p[4].isNull()
    names = {n: F.when(short, p[3 - i]).otherwise(p[4 - i]) for i, n in enumerate(parts[:3])}
    names[parts[3]] = F.when(short, F.lit("%")).otherwise(p[1])
    return names


def _rule_matches(rule, columns: Sequence[str], known: Sequence[str]) -> Column:
    """Condition of one literal rule over item columns."""
    conditions = []
    for c in columns:
        value = rule[f"_re_{c}"]
        conditions.append(F.col(c).rlike(value) if value is not None else F.lit(False))
    for c in ("database_type", "availability_group"):
        if rule.get(c) is not None:
            conditions.append(F.col(c) == rule[c] if c in known else F.lit(False))
    return reduce(lambda a, b: a & b, conditions)


def select_items(
    items: DataFrame,
    rules: DataFrame | None,
    columns: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Items with ``selected`` and ``start_position``.

    An item is selected when some including rule matches and no excluding rule does, whatever their
    order; its position is the least position of the including rules that match.  Rules match all
    ``columns`` (case-insensitive LIKE with a literal ``_``) and their type and group conditions.
    ``rules=None`` selects everything; an item no rule matches is not selected.

    One rule list without ``keys`` is folded into the projection: no join and no shuffle of the
    items.  A very long list, and rule lists per key (for example per server), are joined: names on
    the name, patterns on their rarest piece of text (:func:`pattern_hits`).
    """
    if rules is None:
        return items.withColumns(
            {"selected": F.lit(True), "start_position": F.lit(None).cast("int")}
        )
    if not keys:
        literal = rules.withColumns({f"_re_{c}": like_regex(c) for c in columns})
        listed = literal.limit(LITERAL_RULES + 1).collect()
        if len(listed) <= LITERAL_RULES:
            judged = _judge_by_expression(items, listed, columns)
            return _chosen(judged, items.columns)
    return _chosen(_judge_by_join(items, rules, columns, keys), items.columns)


def _chosen(judged: DataFrame, columns: Sequence[str]) -> DataFrame:
    return judged.withColumn(
        "selected", F.col("start_position").isNotNull() & ~F.col("_excluded")
    ).select(*columns, "selected", "start_position")


def _is_pattern(columns: Sequence[str], prefix: str = "") -> Column:
    parts = [F.col(f"{prefix}{c}") for c in columns]
    return reduce(lambda a, b: a | b, [has_wildcard(p) | p.contains("[") for p in parts])


def _judge_by_expression(items: DataFrame, rules: Sequence, columns: Sequence[str]) -> DataFrame:
    """Items with ``start_position`` and ``_excluded``."""
    listed = [r.asDict() for r in rules]
    includes = sorted((r for r in listed if r["selected"]), key=lambda r: r["start_position"])
    excludes = [r for r in listed if not r["selected"]]
    # The rules are in position order, so the first match has the least position.
    position = F.coalesce(
        *[F.when(_rule_matches(r, columns, items.columns), r["start_position"]) for r in includes],
        F.lit(None).cast("int"),
    )
    hits = [F.coalesce(_rule_matches(r, columns, items.columns), F.lit(False)) for r in excludes]
    excluded = reduce(lambda a, b: a | b, hits, F.lit(False))
    return items.withColumns({"start_position": position, "_excluded": excluded})


def _judge_by_join(
    items: DataFrame, rules: DataFrame, columns: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Items with ``start_position`` and ``_excluded``, from rules met by equality joins.

    Rules that name an item exactly meet it on the name, patterns meet the items that hold their
    rarest piece.
    """
    typed = [c for c in ("database_type", "availability_group") if c in rules.columns]
    known = [c for c in typed if c in items.columns]
    identity = [*keys, *columns, *known]
    base = items.select(*identity).distinct()
    # Equal rules at several places of a list act as the first of them.
    named = (
        rules.select(*[F.col(c).alias(f"_rule_{c}") for c in [*keys, *columns, *typed]], "selected", "start_position")
        .groupBy(*[f"_rule_{c}" for c in [*keys, *columns, *typed]], "selected")
        .agg(F.min("start_position").alias("start_position"))
        .withColumns({f"_re_{c}": like_regex(f"_rule_{c}") for c in columns})
    )
    named = stored(named, "rules")
    same_key = [F.col(k) == F.col(f"_rule_{k}") for k in keys]
    same_type = [F.col(f"_rule_{c}").isNull() | (F.col(f"_rule_{c}") == F.col(c)) for c in known]
    # A rule for a type or group matches nothing where the items do not tell theirs.
    same_type += [F.col(f"_rule_{c}").isNull() for c in typed if c not in known]

    def matches(part: DataFrame, same_name: list[Column]) -> DataFrame:
        condition = reduce(lambda a, b: a & b, [*same_key, *same_name, *same_type])
        return base.join(sized_for_join(part), condition).select(*identity, "selected", "start_position")

    patterned = _is_pattern(columns, "_rule_")
    found = matches(
        named.filter(~patterned), [one_case(c) == one_case(f"_rule_{c}") for c in columns]
    )
    hits = pattern_hits(base, named.filter(patterned), columns, keys)
    found = found.union(
        hits.filter(reduce(lambda a, b: a & b, same_type, F.lit(True))).select(
            *identity, "selected", "start_position"
        )
    )
    verdict = found.groupBy(*identity).agg(
        F.bool_or(~F.col("selected")).alias("_excluded"),
        F.min(F.when(F.col("selected"), F.col("start_position"))).alias("start_position"),
    ).withColumnsRenamed({c: f"_v_{c}" for c in identity})
    same = [F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in identity]
    return items.join(verdict, reduce(lambda a, b: a & b, same), "left").select(
        *items.columns, F.coalesce("_excluded", F.lit(False)).alias("_excluded"), "start_position"
    )


#: Marks of the begin and the end of a name, so that anchored pieces differ from others.
_BEGIN, _END = "\x01", "\x02"


def _pieces(text: Column, number: int) -> Column:
    """All pieces of two and three characters of a text of name column ``number``."""
    size = F.length(text)

    def of(width: int) -> Column:
        starts = F.sequence(F.lit(1), size - width + 1)
        found = F.transform(starts, lambda i: F.concat(F.lit(f"{number}:"), F.substring(text, i, F.lit(width))))
        return F.when(size >= width, found).otherwise(F.array().cast("array<string>"))

    return F.concat(of(2), of(3))


def _name_pieces(columns: Sequence[str]) -> Column:
    marked = [F.concat(F.lit(_BEGIN), one_case(c), F.lit(_END)) for c in columns]
    return F.array_distinct(F.concat(*[_pieces(m, i) for i, m in enumerate(marked)]))


def _pattern_pieces(columns: Sequence[str]) -> Column:
    """The pieces that every name matching the patterns must hold.  A class and a ``%`` end a piece."""

    def of(number: int, column: str) -> Column:
        without = F.regexp_replace(column, r"\[[^\]]+\]", "%")
        parts = F.split(F.concat(F.lit(_BEGIN), without, F.lit(_END)), "%")
        return F.flatten(F.transform(parts, lambda part: _pieces(one_case(part), number)))

    return F.array_distinct(F.concat(*[of(i, c) for i, c in enumerate(columns)]))


def pattern_hits(
    items: DataFrame, rules: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Pairs of an item and a rule whose patterns match all ``columns``.

    ``rules`` holds ``_rule_<name>`` for the keys and columns, ``_re_<column>`` (the pattern as a
    regular expression), ``selected`` and ``start_position``.  A rule is posted under the rarest
    piece of text that its patterns prescribe, an item under all its pieces, and only where they
    meet is the pattern tried.  A rule whose pieces some item does not hold matches nothing; one
    without any piece (such as ``%``, or a single letter between two ``%``) says so little that it
    is tried on every item of its key: such rules travel as one array per key.
    """
    of_rule = [f"_rule_{c}" for c in columns]
    usable = rules.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in of_rule]))
    pieced = usable.withColumn("_pieces", _pattern_pieces(of_rule))
    # Only pieces that some rule prescribes are counted and posted.
    wanted = pieced.select(F.explode("_pieces").alias("_asked")).distinct()
    posted = items.withColumn("_piece", F.explode(_name_pieces(columns)))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        posted = posted.join(F.broadcast(wanted), F.col("_piece") == F.col("_asked"), "left_semi")
    frequency = posted.groupBy(*keys, "_piece").agg(F.count("*").alias("_items")).withColumnsRenamed(
        {k: f"_on_{k}" for k in keys} | {"_piece": "_known"}
    )
    apart = pieced.filter(F.size("_pieces") > 0).withColumn("_piece", F.explode("_pieces")).drop("_pieces")
    held = [F.col(f"_rule_{k}") == F.col(f"_on_{k}") for k in keys] + [F.col("_piece") == F.col("_known")]
    counted = apart.join(frequency, reduce(lambda a, b: a & b, held), "left")
    rarest = (
        counted.groupBy(*rules.columns)
        .agg(F.min(F.struct(F.coalesce("_items", F.lit(0)).alias("n"), "_piece")).alias("_best"))
        .filter("_best.n > 0")
        .select(*rules.columns, F.col("_best._piece").alias("_wanted"))
    )
    rarest = broadcast_if_small(stored(rarest, "posted"))
    same_key = [F.col(k) == F.col(f"_rule_{k}") for k in keys]
    meet = reduce(lambda a, b: a & b, [*same_key, F.col("_piece") == F.col("_wanted")])
    tried = reduce(lambda a, b: a & b, [F.rlike(c, F.col(f"_re_{c}")) for c in columns])
    hits = posted.join(rarest, meet).filter(tried).drop("_piece", "_wanted")

    broad = pieced.filter(F.size("_pieces") == 0).select(*rules.columns)
    listed = F.collect_list(F.struct(*rules.columns)).alias("_rules")
    if keys:
        per_key = broad.groupBy(*[f"_rule_{k}" for k in keys]).agg(listed).withColumnsRenamed(
            {f"_rule_{k}": f"_on_{k}" for k in keys}
        )
        on_key = [F.col(k) == F.col(f"_on_{k}") for k in keys]
        every = items.join(per_key, reduce(lambda a, b: a & b, on_key)).select(*items.columns, "_rules")
    else:
        every = items.withColumn("_rules", broad.agg(listed).scalar())
    spread = every.select(*items.columns, F.inline("_rules")).filter(tried)
    return hits.select(*items.columns, *rules.columns).union(spread.select(*items.columns, *rules.columns))


def order_items(
    items: DataFrame, mode: str | None = None, keys: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Selected items with ``item_order``, their row number in one of eleven orders.

    ``mode=None`` is the order of the selection list (``start_position``, then name).  Ties of the
    other modes are broken by name.  NULL comes first ascending (never-checked databases first).
    ``bounded`` as in :func:`~fleetlens.operators.distributed.ordered_scan`.
    """
    if mode is None:
        order = ["start_position", "name"]
    else:
        column, descending = ORDER_MODES[mode]
        order = [(column, descending)]
        if column != "name":
            order.append("name")
    return ordered_scan(
        items.filter("selected"),
        keys,
        order,
        position="item_order",
        bounded=bounded,
    )


def database_sizes(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Size in pages of the data files of each database, for the size orders."""
    return files.filter("type = 0").groupBy(*keys, "database_id").agg(
        F.sum(F.col("size").cast("bigint")).alias("database_size")
    )


def select_by_group(
    items: DataFrame,
    membership: DataFrame,
    groups: DataFrame,
    on: str = "database_name",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Items of the selected groups, at the position of their group.

    ``groups`` is the output of :func:`select_items` over group names; an item is in one group at
    most.
    """
    chosen = membership.join(
        groups.filter("selected").select(*keys, "group_name", "start_position"),
        [*keys, "group_name"],
    ).select(*keys, on, "start_position")
    return items.join(
        chosen.withColumn("_in", F.lit(True)), [*keys, on], "left"
    ).withColumns({"selected": F.col("_in").isNotNull()}).drop("_in")


def missing_items(
    rules: DataFrame,
    items: DataFrame,
    on: str | Sequence[str] = "database_name",
    keys: Sequence[str] = (),
    pattern: str | None = None,
) -> DataFrame:
    """Names a list spells out but that do not exist, as one quoted text per key (or none).

    ``on`` may be several name parts; ``pattern`` names a part that must hold a wildcard (objects of
    an index list are spelled out with a pattern for the index).
    """
    parts = _parts(on)
    if pattern is not None:
        rules = rules.filter(has_wildcard(pattern))
    named = _explicit(rules, parts, keys)
    absent = named.join(_folded(items, parts, keys), [*keys, "_fold"], "left_anti")
    return _listed(absent, parts, keys)


def selected_elsewhere_not_here(
    rules: DataFrame,
    items: DataFrame,
    on: str | Sequence[str] = "database_name",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Names of a secondary list that exist but are not selected by the primary list."""
    parts = _parts(on)
    named = _explicit(rules, parts, keys)
    here = named.join(_folded(items, parts, keys), [*keys, "_fold"], "left_semi").join(
        _folded(items.filter("selected"), parts, keys), [*keys, "_fold"], "left_anti"
    )
    return _listed(here, parts, keys)


def _parts(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _fold(parts: Sequence[str]) -> Column:
    """Case-insensitive identity of a possibly multi-part name."""
    return F.lower(F.concat_ws(".", *[quote_name(p) for p in parts])).alias("_fold")


def _explicit(rules: DataFrame, parts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    spelled = [F.col(p).isNotNull() & ~has_wildcard(p) for p in parts]
    return rules.filter(reduce(lambda a, b: a & b, spelled)).select(*keys, *parts, _fold(parts))


def _folded(items: DataFrame, parts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return items.select(*keys, _fold(parts))


def _listed(names: DataFrame, parts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    # The text is at most as long as the parameter list it comes from.
    quoted = names.select(*keys, F.concat_ws(".", *[quote_name(p) for p in parts]).alias("_quoted"))
    text = F.expr("listagg(_quoted, ', ') within group (order by _quoted)")
    return quoted.groupBy(*keys).agg(text.alias("names"), F.count("*").alias("n_names")).filter(
        "n_names > 0"
    )


def fs_name_conflicts(
    items: DataFrame, name: str = "name", keys: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Items whose name is empty, or not unique, once reduced to file-name characters.

    Only problems that touch a selected item are reported.  ``problem`` is ``EMPTY`` or
    ``DUPLICATE``.
    """
    reduced = items.withColumns({"name_fs": file_system_name(name)}).withColumn(
        "_fold", F.upper("name_fs")
    )
    clashes = (
        reduced.filter("name_fs <> ''")
        .groupBy(*keys, "_fold")
        .agg(F.count("*").alias("_n"), F.bool_or("selected").alias("_any"))
        .filter("_n > 1 and _any")
    )
    duplicates = reduced.join(clashes, [*keys, "_fold"], "left_semi").withColumn(
        "problem", F.lit("DUPLICATE")
    )
    empty = reduced.filter("selected and name_fs = ''").withColumn("problem", F.lit("EMPTY"))
    return duplicates.unionByName(empty).select(*keys, *keep, name, "name_fs", "problem")


def sync_worklist(queue: DataFrame, items: DataFrame, on: Sequence[str]) -> DataFrame:
    """The next version of a work list.

    Selected items missing from the queue are inserted, queue rows that are no longer selected are
    deleted, and the order of the others is refreshed; ``action`` says which.  Other columns of the
    queue are carried over.
    """
    carried = [c for c in queue.columns if c not in (*on, "item_order")]
    new = items.filter("selected").select(
        *on, F.col("item_order").alias("_new_order"), F.lit(True).alias("_wanted")
    )
    old = queue.withColumn("_queued", F.lit(True))
    action = (
        F.when(F.col("_queued").isNull(), "INSERT")
        .when(F.col("_wanted").isNull(), "DELETE")
        .otherwise("UPDATE")
    )
    return old.join(new, list(on), "full").select(
        *on,
        F.coalesce("_new_order", "item_order").alias("item_order"),
        *carried,
        action.alias("action"),
    )


def apply_sync(synced: DataFrame) -> DataFrame:
    """The rows that stay in the work list after :func:`sync_worklist`."""
    return synced.filter("action <> 'DELETE'").drop("action")


def pending(worklist: DataFrame, done: str = "completed", order: Sequence[str] = ("item_order",)):
    """Incomplete items in work order."""
    return worklist.filter(~F.coalesce(done, F.lit(False))).orderBy(*order)


def mark_done(
    worklist: DataFrame, finished: DataFrame, on: Sequence[str], done: str = "completed"
) -> DataFrame:
    """The work list with the ``finished`` items completed."""
    flags = finished.select(*on).distinct().withColumn("_finished", F.lit(True))
    columns = [
        F.coalesce("_finished", done, F.lit(False)).alias(done) if c == done else F.col(c)
        for c in worklist.columns
    ]
    return worklist.join(flags, list(on), "left").select(*columns)


def validate_choices(values: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values that are not allowed, or given more than once; a NULL value is not checked.

    ``problem`` is ``NOT_ALLOWED`` or ``DUPLICATE``.
    """
    counted = values.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("n_values")
    )
    unknown = counted.filter(~F.col(column).isin(*allowed)).withColumn(
        "problem", F.lit("NOT_ALLOWED")
    )
    repeated = counted.filter("n_values > 1").withColumn("problem", F.lit("DUPLICATE"))
    return unknown.unionByName(repeated).select(column, "problem", "n_values")


def as_rules(spark, text: str | None, kind: str = "databases", delimiter: str = ",") -> DataFrame:
    """Rules of one list parameter."""
    schema = T.StructType([T.StructField("list", T.StringType())])
    return parse_rules(split_list(spark.createDataFrame([(text,)], schema), "list", delimiter), kind)

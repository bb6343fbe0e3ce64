"""XML events, key-value reports and text search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.text import like_regex, quote_name
from fleetlens.operators.distributed import top_n

_ITEM = "array<struct<_name: string, value: string>>"
_EVENT = f"_name string, _timestamp string, data {_ITEM}, action {_ITEM}"
_RING_BUFFER = f"event array<struct<_name: string, _timestamp: string, data: {_ITEM}, action: {_ITEM}>>"

# An event element with its content; events do not nest.  Quoted values, comments and CDATA may hold
# anything, also what looks like the end of the event.
_ATTRIBUTES = r"""(?:[^>"'/]|"[^"]*"|'[^']*'|/(?!>))*+"""
_BODY = r"(?:[^<]++|<!\[CDATA\[.*?\]\]>|<!--.*?-->|<(?!/event>|!\[CDATA\[|!--))*+"
_EVENT_NODE = rf"(?s)<event(?=[\s>/]){_ATTRIBUTES}(?:/>|>{_BODY}</event>)"

# The kind of event a deadlock leaves, and the field holding the last good check.
DEADLOCK_REPORT = "xml_deadlock_report"
LAST_GOOD_FIELD = "dbi_dbccLastKnownGood"

#: Width of the value column of :func:`search_all_strings`.
SEARCH_VALUE_WIDTH = 3630


def _event_time(event: str = "_event") -> Column:
    """Time of the event; NULL when it is missing or no time."""
    return F.regexp_replace(F.col(f"{event}._timestamp"), "Z$", "").try_cast("timestamp_ntz")


#: An event element; the text of one that is no XML is in ``malformed``.
XML_EVENT = f"{_EVENT}, malformed string"
#: Event files are read as text up to each end of an event, so that large files are split.
EVENT_END = "</event>"


def event_records(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per event element of event files, from ``value``: the text up to an :data:`EVENT_END`.

    Every element is parsed by itself, so a broken one hides no other: it stays as a row with its
    text in ``malformed``.  So does what looks like an event but has no end of its own, such as an
    element whose text holds the end of an event.  An element that a file breaks off right before
    its end counts as whole.
    """
    text = F.concat("value", F.lit(EVENT_END))
    nodes = F.regexp_extract_all("_text", F.lit(_EVENT_NODE), F.lit(0))
    rest = F.regexp_replace(F.regexp_replace("_text", _EVENT_NODE, ""), r"(?s)<!--.*?-->", "")
    cut = F.when(F.rlike(rest, F.lit(r"<event[\s>/]")), F.array(F.struct(rest.alias("_node"), F.lit(True).alias("_cut"))))
    whole = F.transform(nodes, lambda n: F.struct(n.alias("_node"), F.lit(False).alias("_cut")))
    none = F.slice(whole, 1, 0)
    options = {"rowTag": "event", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    parsed = (
        df.select(*keep, text.alias("_text"))
        .select(*keep, F.inline(F.concat(whole, F.coalesce(cut, none))))
        .withColumn("_event", F.when(~F.col("_cut"), F.from_xml("_node", XML_EVENT, options)))
    )
    broken = F.col("_cut") | F.col("_event.malformed").isNotNull()
    return parsed.select(
        *keep,
        F.when(~broken, _event_time()).alias("event_timestamp"),
        F.when(~broken, F.col("_event._name")).alias("event_name"),
        F.when(~broken, F.col("_event.data")).alias("data"),
        F.when(~broken, F.col("_event.action")).alias("action"),
        F.when(broken, F.col("_node")).alias("malformed"),
    )


def shred_events(
    df: DataFrame,
    xml_col: str = "target_data",
    keep: Sequence[str] = (),
    event_name: str | None = None,
) -> DataFrame:
    """Ring-buffer documents as one row per event: UTC time, name and the event element.

    ``event_name`` restricts to one kind of event.
    """
    nodes = df.select(
        *keep, F.explode(F.regexp_extract_all(xml_col, F.lit(_EVENT_NODE), F.lit(0))).alias("event")
    )
    parsed = nodes.withColumn("_event", F.from_xml("event", _EVENT))
    if event_name is not None:
        parsed = parsed.filter(F.col("_event._name") == event_name)
    return parsed.select(
        *keep, _event_time().alias("event_timestamp"), F.col("_event._name").alias("event_name"), "event"
    )


def deadlock_events(
    df: DataFrame, xml_col: str = "target_data", keep: Sequence[str] = (), ordered: bool = True
) -> DataFrame:
    """Deadlock reports of ring-buffer documents, newest first."""
    out = shred_events(df, xml_col, keep, DEADLOCK_REPORT)
    return out.orderBy(F.desc("event_timestamp")) if ordered else out


def lookup_statement(events: DataFrame, texts: DataFrame, on: str = "sql_handle") -> DataFrame:
    """Statement text of a handle."""
    return events.join(texts.select(on, "text"), on)


def item_value(items: str, name: str) -> Column:
    """Value of the first data item or action with the given name."""
    found = F.filter(F.col(items), lambda x: x["_name"] == name)
    return F.get(found, F.lit(0))["value"]


def login_failures(
    df: DataFrame, xml_col: str = "target_data", keep: Sequence[str] = ()
) -> DataFrame:
    """Events with the message, client and database of a failed login."""
    parsed = df.select(
        *keep, F.explode(F.from_xml(F.col(xml_col), _RING_BUFFER)["event"]).alias("_event")
    )
    return parsed.select(
        *keep,
        _event_time().alias("event_timestamp"),
        item_value("_event.data", "message").alias("event_message"),
        item_value("_event.action", "client_app_name").alias("client_app_name"),
        item_value("_event.action", "client_hostname").alias("client_hostname"),
        item_value("_event.action", "database_id").try_cast("int").alias("database_id"),
    )


def recent_deadlocks(
    files: DataFrame,
    pattern: str | Column | None = None,
    tz: str = "UTC",
    n: int = 30,
    keep: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` newest deadlock reports of event files (of each key), in the time zone ``tz``.

    A missing or malformed time is NULL and counts as the oldest.

    Input rows: ``file_name``, ``object_name`` and ``event_data`` (one event element).  ``pattern``
    is a file-name pattern with ``*``, for example from
    :func:`~fleetlens.functions.text.parent_pattern`.
    """
    rows = files.filter(F.lower("object_name") == DEADLOCK_REPORT)
    if pattern is not None:
        wanted = F.lit(pattern) if isinstance(pattern, str) else pattern
        like = F.replace(wanted, F.lit("*"), F.lit("%"))
        rows = rows.filter(F.rlike("file_name", like_regex(like)))
    stamp = F.regexp_replace(F.xpath_string("event_data", F.lit("/event/@timestamp")), "Z$", "")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), stamp.try_cast("timestamp_ntz"))
    kept = [*keys, *[c for c in keep if c not in keys]]
    reports = rows.select(*kept, local.alias("local_time"), F.col("event_data").alias("deadlock_report"))
    return top_n(reports, n, [F.desc("local_time"), F.col("deadlock_report")], keys)


def last_good_check(
    eav: DataFrame, keys: Sequence[str] = (), ordered: bool = True
) -> DataFrame:
    """Time of the last successful integrity check per database, newest first."""
    out = (
        eav.filter(F.col("field") == LAST_GOOD_FIELD)
        .groupBy(*keys, "database_name")
        .agg(F.max(F.col("value").try_cast("timestamp_ntz")).alias("last_good_check"))
    )
    return out.orderBy(F.desc("last_good_check"), *keys, "database_name") if ordered else out


def search_all_strings(tables: Mapping[str, DataFrame], needle: str) -> DataFrame:
    """Every value of every string column that contains ``needle``, case-insensitively.

    ``tables`` maps ``schema.table`` to its rows.  One scan per table reads its string columns only.
    ``%``, ``_`` and ``[...]`` in the needle are wildcards, a backslash is a character.  The value is shown up to 3630 characters; the
    search looks at all of it.
    """
    found = []
    for name, df in tables.items():
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not columns:
            continue
        table = ".".join(f"[{part.replace(']', ']]')}]" for part in name.split("."))
        hits = F.array_compact(
            F.array(
                *[
                    F.when(
                        F.rlike(c, like_regex(F.lit(f"%{needle}%"), literal_underscore=False)),
                        F.struct(
                            F.concat(F.lit(table + "."), quote_name(F.lit(c))).alias("column_name"),
                            F.left(F.col(c), F.lit(SEARCH_VALUE_WIDTH)).alias("column_value"),
                        ),
                    )
                    for c in columns
                ]
            )
        )
        found.append(df.select(F.inline(hits)))
    if not found:
        raise ValueError("no table with a string column")
    return reduce(DataFrame.union, found)

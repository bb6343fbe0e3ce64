"""Events: XML documents built from the events table and shredded back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import parent_pattern
from fleetlens.operators import events, needles
from fleetlens.operators.distributed import ensure_checkpoint_dir
from fleetlens.operators.needles import needle_index
from fleetlens.sources.readers import read_event_xml
from proxies.base import load, query

_SQL_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_SQL_EVENT = f"""'<event name="' || event_type || '" timestamp="' || {_SQL_STAMP} || 'Z">'
    || '<data name="message"><value>' || props || '</value></data>'
    || '<action name="client_app_name"><value>app ' || CAST(user_id AS VARCHAR) || '</value></action>'
    || '<action name="client_hostname"><value>host-' || event_type || '</value></action>'
    || '<action name="database_id"><value>' || CAST(user_id AS VARCHAR) || '</value></action></event>'"""


def event_element():
    """The XML element of an events row."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    user = F.col("user_id").cast("string")
    return F.concat(
        F.lit('<event name="'), "event_type", F.lit('" timestamp="'), stamp, F.lit('Z">'),
        F.lit('<data name="message"><value>'), "props", F.lit("</value></data>"),
        F.lit('<action name="client_app_name"><value>app '), user, F.lit("</value></action>"),
        F.lit('<action name="client_hostname"><value>host-'), "event_type",
        F.lit("</value></action>"),
        F.lit('<action name="database_id"><value>'), user, F.lit("</value></action></event>"),
    )


def ring_buffers(spark, sf: str) -> DataFrame:
    """One ring-buffer document per events row, holding the event and a heartbeat."""
    heartbeat = F.lit('<event name="heartbeat" timestamp="2024-01-01T00:00:00.000Z"></event>')
    document = F.concat(
        F.lit('<RingBufferTarget truncated="0">'), event_element(), heartbeat,
        F.lit("</RingBufferTarget>"),
    )
    return load(spark, sf, "events").select("event_id", document.alias("target_data"))


@query(
    "shred_events",
    f"""SELECT event_id, ts AS event_timestamp, event_type AS event_name, {_SQL_EVENT} AS event FROM events
    UNION ALL
    SELECT event_id, TIMESTAMP '2024-01-01', 'heartbeat',
      '<event name="heartbeat" timestamp="2024-01-01T00:00:00.000Z"></event>' FROM events""",
)
def shred_events(spark, sf):
    return events.shred_events(ring_buffers(spark, sf), keep=["event_id"])


@query(
    "shred_events_by_name",
    f"""SELECT event_id, ts AS event_timestamp, event_type AS event_name, {_SQL_EVENT} AS event
    FROM events WHERE event_type = 'error'""",
)
def shred_events_by_name(spark, sf):
    return events.shred_events(ring_buffers(spark, sf), keep=["event_id"], event_name="error")


_LOGINS_SQL = """SELECT event_id, ts AS event_timestamp, props AS event_message,
      'app ' || CAST(user_id AS VARCHAR) AS client_app_name, 'host-' || event_type AS client_hostname,
      CAST(user_id AS INTEGER) AS database_id FROM events
    UNION ALL
    SELECT event_id, TIMESTAMP '2024-01-01', NULL, NULL, NULL, NULL FROM events"""


@query("login_failures", _LOGINS_SQL)
def login_failures(spark, sf):
    return events.login_failures(ring_buffers(spark, sf), keep=["event_id"])


def event_files(spark, sf: str) -> str:
    """The ring buffers as XML files in the shared folder; every 50th event has a wrong end tag."""
    folder = f"{ensure_checkpoint_dir(spark)}/event-files-{uuid4().hex}"
    broken = F.regexp_replace(event_element(), "</value></data>", "</data>")
    element = F.when(F.col("event_id") % 50 == 0, broken).otherwise(event_element())
    # One document per day.
    days = load(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_id", element.alias("event"))
    texts = days.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("event_id", "event"))).alias("e")).select(
        F.concat(
            F.lit("<RingBufferTarget>\n"), F.array_join(F.col("e.event"), "\n"), F.lit("</RingBufferTarget>")
        ).alias("value")
    )
    texts.repartition(8).write.text(folder)
    return folder


@query(
    "read_event_xml",
    """SELECT CASE WHEN event_id % 50 <> 0 THEN ts END AS event_timestamp,
      CASE WHEN event_id % 50 <> 0 THEN event_type END AS event_name,
      CASE WHEN event_id % 50 <> 0 THEN props END AS message,
      CASE WHEN event_id % 50 <> 0 THEN 'host-' || event_type END AS host,
      event_id % 50 = 0 AS is_malformed, count(*) AS n
    FROM events GROUP BY ALL""",
)
def event_xml(spark, sf):
    rows = read_event_xml(spark, event_files(spark, sf))
    return rows.select(
        "event_timestamp", "event_name", events.item_value("data", "message").alias("message"),
        events.item_value("action", "client_hostname").alias("host"),
        F.col("malformed").isNotNull().alias("is_malformed"),
    ).groupBy("event_timestamp", "event_name", "message", "host", "is_malformed").agg(F.count("*").alias("n"))


@query(
    "lookup_statement",
    """SELECT o.o_orderkey AS sql_handle, o.o_orderdate AS event_timestamp, p_name AS text
    FROM orders o JOIN part ON o.o_orderkey = p_partkey""",
)
def lookup_statement(spark, sf):
    found = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sql_handle"), F.col("o_orderdate").alias("event_timestamp")
    )
    texts = load(spark, sf, "part").select(F.col("p_partkey").alias("sql_handle"), F.col("p_name").alias("text"))
    return events.lookup_statement(found, texts)


@query(
    "deadlock_events",
    f"""SELECT event_id, ts AS event_timestamp, '{events.DEADLOCK_REPORT}' AS event_name,
      replace({_SQL_EVENT}, '<event name="error"', '<event name="{events.DEADLOCK_REPORT}"') AS event
    FROM events WHERE event_type = 'error'""",
)
def deadlock_events(spark, sf):
    named = F.replace(
        F.col("target_data"), F.lit('<event name="error"'), F.lit(f'<event name="{events.DEADLOCK_REPORT}"')
    )
    buffers = ring_buffers(spark, sf).withColumn("target_data", named)
    return events.deadlock_events(buffers, keep=["event_id"], ordered=False)


@query(
    "recent_deadlocks",
    f"""SELECT ts + INTERVAL 1 HOUR AS local_time, {_SQL_EVENT} AS deadlock_report FROM events
    WHERE event_type = 'error' AND user_id % 2 = 0 ORDER BY local_time DESC LIMIT 30""",
)
def recent_deadlocks(spark, sf):
    # Half of the files belong to another session and must not match the wildcard.
    name = F.concat(
        F.when(F.col("user_id") % 2 == 0, "C:\\log\\System_Health_").otherwise("C:\\log\\other_"),
        F.col("event_id").cast("string"),
        F.lit(".xel"),
    )
    files = load(spark, sf, "events").select(
        name.alias("file_name"),
        F.when(F.col("event_type") == "error", events.DEADLOCK_REPORT).otherwise("wait_info")
        .alias("object_name"),
        event_element().alias("event_data"),
    )
    pattern = parent_pattern(F.lit("C:\\log\\system_health_0_1.xel"), "system_health*.xel")
    return events.recent_deadlocks(files, pattern, tz="+01:00")


@query(
    "recent_deadlocks_per_server",
    f"""SELECT user_id % 7 AS server, ts + INTERVAL 1 HOUR AS local_time, {_SQL_EVENT} AS deadlock_report
    FROM events WHERE event_type = 'error'
    QUALIFY row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, {_SQL_EVENT}) <= 3""",
)
def recent_deadlocks_per_server(spark, sf):
    files = load(spark, sf, "events").select(
        (F.col("user_id") % 7).alias("server"),
        F.lit("a.xel").alias("file_name"),
        F.when(F.col("event_type") == "error", events.DEADLOCK_REPORT).alias("object_name"),
        event_element().alias("event_data"),
    )
    return events.recent_deadlocks(files, tz="+01:00", n=3, keys=["server"])


@query(
    "parent_pattern",
    """SELECT page_id, regexp_replace(url, '[^/]*$', '') || '*.html' AS pattern FROM pages""",
)
def parent_patterns(spark, sf):
    return load(spark, sf, "pages").select(
        "page_id", parent_pattern("url", "*.html", "/").alias("pattern")
    )


@query(
    "last_good_check",
    """SELECT CAST(o_custkey AS VARCHAR) AS database_name, max(o_orderdate) AS last_good_check
    FROM orders GROUP BY o_custkey""",
)
def last_good_check(spark, sf):
    fields = F.expr(
        "stack(3, 'dbi_dbccLastKnownGood', date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss.SSS'), "
        "'dbi_status', o_orderstatus, 'dbi_modDate', o_orderpriority)"
    )
    eav = load(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("database_name"), fields.alias("field", "value")
    )
    return events.last_good_check(eav)


SEARCHED = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "conversations": ["role", "text"],
    "benchmark": ["text"],
}


def _sql_search(pattern: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '[dbo].[{t}].[{c}]' AS column_name, left({c}, 3630) AS column_value FROM {t} "
        f"WHERE {c} ILIKE '{pattern}'"
        for t, columns in SEARCHED.items()
        for c in columns
    )


@query("search_with_index", _sql_search("%ECONOMY%"))
def search_with_index(spark, sf):
    """The index is made, kept as a table, and asked."""
    tables = {f"dbo.{t}": load(spark, sf, t) for t in SEARCHED}
    folder = f"{ensure_checkpoint_dir(spark)}/needles-{uuid4().hex}"
    needle_index(tables).write.parquet(folder)
    return needles.search_with_index(spark, tables, spark.read.parquet(folder), "Economy")


@query("search_all_strings", _sql_search("%license%"))
def search_all_strings(spark, sf):
    tables = {f"dbo.{t}": load(spark, sf, t) for t in SEARCHED}
    return events.search_all_strings(tables, "license")

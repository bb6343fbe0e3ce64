"""Reading landed telemetry."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.events import EVENT_END, event_records
from fleetlens.sources.schemas import schema_of

log = logging.getLogger(__name__)


def read_landed(
    spark: SparkSession, root: str, table: str, fmt: str = "parquet", keyed: bool = True
) -> DataFrame:
    """A landed table with its declared schema (nothing is inferred)."""
    return spark.read.schema(schema_of(table, keyed)).format(fmt).load(f"{root}/{table}")


def stream_landed(
    spark: SparkSession, root: str, table: str, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """A landed table as a stream of arriving files, in bounded micro-batches."""
    return (
        spark.readStream.schema(schema_of(table))
        .option("maxFilesPerTrigger", files_per_batch)
        .format(fmt)
        .load(f"{root}/{table}")
    )


def read_view(
    spark: SparkSession, url: str, query: str, server: str, properties: Mapping[str, str]
) -> DataFrame:
    """A system view of one server over JDBC, tagged with the server and the time of reading."""
    return (
        spark.read.format("jdbc")
        .options(url=url, query=query, **properties)
        .load()
        .withColumns({"server": F.lit(server), "snapshot_ts": F.current_timestamp()})
    )


def union_sources(
    sources: Mapping[str, Callable[[], DataFrame]], key: str = "server"
) -> tuple[DataFrame, dict[str, str]]:
    """The rows of all sources, tagged with their name, and the sources that could not be opened.

    A failing source is logged and skipped.
    """
    frames, failures = [], {}
    for name, open_source in sources.items():
        try:
            frames.append(open_source().withColumn(key, F.lit(name)))
        except Exception as error:  # noqa: BLE001 - any source error is reported, not raised
            log.warning("source %s skipped: %s", name, error)
            failures[name] = str(error)
    if not frames:
        raise ValueError(f"no source could be opened: {sorted(failures)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), failures


def read_event_files(spark: SparkSession, pattern: str, fmt: str = "json") -> DataFrame:
    """Event files by wildcard: ``object_name``, ``event_data`` and the ``file_name`` they are in."""
    return (
        spark.read.schema("object_name string, event_data string")
        .format(fmt)
        .load(pattern)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def read_event_xml(spark: SparkSession, pattern: str) -> DataFrame:
    """Event files as XML: a row per event element, with the ``file_name`` it is in.

    Columns: ``file_name``, ``event_timestamp``, ``event_name``, the named items ``data`` and
    ``action``, and ``malformed``, the text of an element that is no XML (then the others are NULL).
    """
    return _event_files(spark.read.option("lineSep", EVENT_END).text(pattern))


def stream_event_xml(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """:func:`read_event_xml` over files as they arrive."""
    arriving = spark.readStream.option("lineSep", EVENT_END).option("maxFilesPerTrigger", files_per_batch)
    return _event_files(arriving.text(folder))


def _event_files(texts: DataFrame) -> DataFrame:
    return event_records(texts.withColumn("file_name", F.col("_metadata.file_name")), ["file_name"])

"""Text search that opens only files that may hold the needle.

The index is a table: for each file and string column a Bloom filter of the pieces of three
characters in the column's values, letters in one case.  Every task fills filters for its part of a
file, which are then put together; the index is kept wherever tables are kept.  A search asks it for
the files and columns whose filters hold every piece of the needle and reads those alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache, reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.events import search_all_strings

PIECE = 3
#: Bits of a filter, in parts as large as Spark's bitmaps.
BITMAP_BITS = 32_768
PARTS = 8
FILTER_BITS = (BITMAP_BITS * PARTS).bit_length() - 1
#: Bytes of values whose pieces are in memory at once, about.
PORTION = 1_000_000
#: Filters a task fills at once, 262,144 bytes each.
MOST_FILTERS = 256


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """For every character the one that stands for its letter in any case.

    Characters with an upper or lower form of one character share a place with it, as in case-insensitive
    patterns; those with a longer form stand for themselves.
    """
    points = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        upper = chr(c).upper()
        upper = upper if len(upper) == 1 else chr(c)
        lower = upper.lower()
        points[c] = ord(lower if len(lower) == 1 else upper)
    return points


def piece_bits(texts: Sequence[str | None]) -> np.ndarray:
    """Bits of all pieces of the texts, repeats included; pieces do not reach from one text into the next."""
    texts = [t for t in texts if t is not None and len(t) >= PIECE]
    if not texts:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = _folds()[points].astype(np.uint64)
    # 21 bits hold any character, so a piece is one number before it is hashed.
    piece = points[: -PIECE + 1].copy()
    for i in range(1, PIECE):
        piece = (piece << np.uint64(21)) | points[i : len(points) - PIECE + 1 + i]
    piece *= np.uint64(0x9E3779B97F4A7C15)
    piece ^= piece >> np.uint64(32)
    piece *= np.uint64(0xD6E8FEB86659FD93)
    inside = np.ones(len(points), dtype=bool)
    for i in range(1, PIECE):
        inside[np.cumsum(size) - i] = False
    return (piece >> np.uint64(64 - FILTER_BITS))[inside[: len(piece)]].astype(np.int64)


def _portions(column: pa.Array) -> Iterator[list[str | None]]:
    """The values of a column, as many at once as have about ``PORTION`` bytes; one longer value stands alone."""
    at = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // PORTION
    cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [len(column)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield column.slice(begin, end - begin).to_pylist()


def _filters(columns: Sequence[str]):
    """A filter per file and column of the rows of a task, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}

        def drain() -> pa.RecordBatch:
            rows = [
                (path, column, part, np.packbits(bits, bitorder="little").tobytes())
                for (path, column), filled in held.items()
                for part, bits in enumerate(filled.reshape(PARTS, BITMAP_BITS))
                if bits.any()
            ]
            held.clear()
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["file_path", "column_name", "part", "bits"])

        for batch in batches:
            paths = batch.column(0).dictionary_encode()
            for number, path in enumerate(paths.dictionary.to_pylist()):
                here = batch if len(paths.dictionary) == 1 else batch.filter(pc.equal(paths.indices, number))
                for i, column in enumerate(columns):
                    for texts in _portions(here.column(i + 1)):
                        bits = piece_bits(texts)
                        if len(bits):
                            if (path, column) not in held:
                                held[path, column] = np.zeros(PARTS * BITMAP_BITS, dtype=bool)
                            held[path, column][bits] = True
                if len(held) > MOST_FILTERS:
                    yield drain()
        if held:
            yield drain()

    return run


def needle_index(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, file_path, column_name, part, bits)`` of tables read from files.

    ``tables`` maps ``schema.table`` to its rows, as for
    :func:`~fleetlens.operators.events.search_all_strings`.  A file without any piece in a column has
    no row for it.  A task fills the filters of its files itself and sends them on, not the pieces.
    """
    filters = []
    for name, df in tables.items():
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not columns:
            continue
        # Values without a piece stay behind.
        texts = [F.make_valid_utf8(F.col(f"`{c}`")) for c in columns]
        long = [F.when(F.length(t) >= PIECE, t).alias(f"_{i}") for i, t in enumerate(texts)]
        held = df.select(F.col("_metadata.file_path").alias("file_path"), *long).filter(
            reduce(lambda a, b: a | b, [F.col(f"_{i}").isNotNull() for i in range(len(columns))])
        )
        made = held.mapInArrow(_filters(columns), "file_path string, column_name string, part long, bits binary")
        filters.append(
            made.groupBy(F.lit(name).alias("table_name"), "file_path", "column_name", "part").agg(
                F.bitmap_or_agg("bits").alias("bits")
            )
        )
    if not filters:
        raise ValueError("no table with a string column")
    return reduce(DataFrame.union, filters)


def files_to_open(index: DataFrame, needle: str) -> DataFrame | None:
    """``(table_name, column_name, file_path)`` that may hold the needle; None when all may.

    Wildcards cut the needle; a needle without a run of three plain characters says nothing.
    """
    runs = [r for r in re.split(r"\[[^\]]+\]|[%_]", needle) if len(r) >= PIECE]
    if not runs:
        return None
    wanted = sorted(set(piece_bits(runs).tolist()))
    place = [(b // BITMAP_BITS, b % BITMAP_BITS // 8, b % 8) for b in wanted]

    def is_set(part: int, byte: int, bit: int) -> Column:
        one = F.conv(F.hex(F.substring("bits", byte + 1, 1)), 16, 10).cast("int")
        return F.when(F.col("part") == part, F.call_function("bit_get", one, F.lit(bit))).otherwise(0)

    hits = sum((is_set(*p).cast("int") for p in place), F.lit(0))
    return (
        index.groupBy("table_name", "column_name", "file_path")
        .agg(F.sum(hits).alias("hits"))
        .filter(F.col("hits") == len(place))
        .select("table_name", "column_name", "file_path")
    )


def search_with_index(
    spark: SparkSession, tables: Mapping[str, DataFrame], index: DataFrame, needle: str, fmt: str = "parquet"
) -> DataFrame:
    """The rows of :func:`~fleetlens.operators.events.search_all_strings`, from the files that may
    hold the needle.

    ``index`` must cover the files of ``tables``; files that came later are not searched.
    """
    found = files_to_open(index, needle)
    if found is None:
        return search_all_strings(tables, needle)
    # Names of files: Spark's planning of a scan holds as many.
    chosen: dict[str, dict[str, list[str]]] = {}
    listed = found.groupBy("table_name", "file_path").agg(F.sort_array(F.collect_set("column_name")).alias("columns"))
    for r in listed.collect():
        group = chosen.setdefault(r.table_name, {})
        group.setdefault("\0".join(r.columns), []).append(unquote(r.file_path))
    results = []
    for name, groups in chosen.items():
        for columns, paths in groups.items():
            files = spark.read.schema(tables[name].schema).format(fmt).load(paths)
            results.append(search_all_strings({name: files.select(*columns.split("\0"))}, needle))
    if not results:
        return spark.createDataFrame([], "column_name string, column_value string")
    return reduce(DataFrame.union, results)

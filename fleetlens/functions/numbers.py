"""Exact integer and decimal arithmetic on columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(value) -> Column:
    """A column for a name, a column or a plain number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def int_div(num, den) -> Column:
    """Integer division truncating towards zero; NULL when the divisor is 0."""
    return F.call_function("div", as_col(num), F.nullif(as_col(den), F.lit(0)))


def ratio(
    num: str, den: str | int, precision: int, scale: int, factor: int = 1, on_zero=None
) -> Column:
    """``factor * num / den`` as ``DECIMAL(precision, scale)``, rounded half away from zero.

    ``num`` and ``den`` are integer expressions (SQL text, or a number for ``den``).  Only integers
    are divided, so the result does not depend on floating point.  Quotient and remainder are scaled
    apart, which keeps ordinary values in BIGINT; a divisor too large for that is handled in wide
    decimals.  A zero divisor gives ``on_zero`` (NULL by default).
    """
    shift = factor * 10**scale
    limit = (2**63 - 1) // (2 * shift + 1)
    n, d = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)"
    if isinstance(den, int) and 0 < den <= limit:
        units = (
            f"abs({n}) div {den}L * {shift}L + (abs({n}) % {den}L * {2 * shift}L + {den}L) div {2 * den}L"
        )
        negative = f"{n} < 0"
    else:
        size = f"nullif(abs({d}), 0L)"
        rest = f"abs({n}) % {size}"
        wide = (
            f"(CAST({rest} AS DECIMAL(38, 0)) * CAST({2 * shift} AS DECIMAL(18, 0)) "
            f"+ CAST({size} AS DECIMAL(38, 0))) div (CAST({size} AS DECIMAL(38, 0)) * 2)"
        )
        units = (
            f"abs({n}) div {size} * {shift}L + CASE WHEN {size} <= {limit}L "
            f"THEN ({rest} * {2 * shift}L + {size}) div ({size} * 2L) ELSE {wide} END"
        )
        negative = f"({n} < 0) <> ({d} < 0)"
    signed = f"CASE WHEN {negative} THEN -({units}) ELSE {units} END"
    unit = f"CAST('{Decimal(1).scaleb(-scale):f}' AS DECIMAL({scale + 1}, {scale}))"
    kind = f"DECIMAL({precision}, {scale})"
    out = f"CAST(CAST({signed} AS DECIMAL(20, 0)) * {unit} AS {kind})"
    if on_zero is not None:
        out = f"CASE WHEN {d} = 0 THEN CAST({on_zero} AS {kind}) ELSE {out} END"
    return F.expr(out)


def pages_to_mb(pages) -> Column:
    """8 KiB pages as whole megabytes (``pages * 8 / 1024`` in integer arithmetic)."""
    return int_div(as_col(pages).cast("bigint") * 8, 1024)


def pages_to_mb_exact(pages: str, precision: int = 10, scale: int = 2) -> Column:
    """8 KiB pages as decimal megabytes."""
    return ratio(pages, 128, precision, scale)


def elapsed_micros(start: str, end: str) -> Column:
    """Microseconds from one timestamp (SQL text) to another of the same kind.

    Zone-less timestamps are subtracted as they are, so the session zone and its daylight saving
    play no part.
    """
    seconds = f"CAST(CAST({end} - {start} AS INTERVAL SECOND) AS DECIMAL(18, 6))"
    return F.expr(f"CAST({seconds} * 1000000 AS BIGINT)")


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros_of(column: str, kind: T.DataType) -> Column:
    """A timestamp as microseconds since 1970; a zone-less one as if it were UTC."""
    if isinstance(kind, T.TimestampNTZType):
        return elapsed_micros(_EPOCH, f"`{column}`")
    return F.unix_micros(F.col(column).cast("timestamp"))


def from_micros(column: str, kind: T.DataType) -> Column:
    """The timestamp that :func:`micros_of` was given."""
    if isinstance(kind, T.TimestampNTZType):
        since = f"make_dt_interval(0, 0, 0, CAST(`{column}` AS DECIMAL(20, 0)) / 1000000)"
        return F.expr(f"{_EPOCH} + {since}")
    return F.timestamp_micros(column).cast(kind)


def seconds_between(start, end) -> Column:
    """Seconds between two timestamps, both truncated to the second first."""

    def whole(value) -> Column:
        return F.unix_timestamp(F.date_trunc("second", as_col(value)))

    return whole(end) - whole(start)

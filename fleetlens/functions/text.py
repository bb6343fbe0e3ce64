"""Name, pattern and duration texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.numbers import as_col, int_div

# Fixed value: the characters a Windows file name cannot hold.
RESERVED_FILE_CHARACTERS = '\\/:*?"<>|'

# A dot that is followed only by balanced [..] parts, i.e. a dot outside brackets.
_DOT_OUTSIDE_BRACKETS = r"\.(?=(?:[^\[\]]|\[(?:[^\]]|\]\])*\])*$)"


def concat_text(*parts) -> Column:
    """Concatenation where plain Python strings are literals; NULL if any part is NULL."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def quote_name(name, quote: str = "[") -> Column:
    """A delimited identifier: ``[a]]b]`` or, with ``quote="'"``, ``'a''b'``."""
    close = "]" if quote == "[" else quote
    body = F.replace(as_col(name), F.lit(close), F.lit(close * 2))
    return concat_text(quote, body, close)


def name_parts(name) -> Column:
    """The parts of a dotted name from right to left, without their brackets; empty parts are NULL.

    An empty array when there are more than four parts.
    """
    pieces = F.reverse(F.split(as_col(name), _DOT_OUTSIDE_BRACKETS))

    def bare(piece: Column) -> Column:
        bracketed = piece.startswith("[") & piece.endswith("]") & (F.length(piece) >= 2)
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        value = F.when(bracketed, F.replace(inner, F.lit("]]"), F.lit("]"))).otherwise(piece)
        return F.nullif(value, F.lit(""))

    few = F.filter(F.array(pieces), lambda p: F.size(p) <= 4)
    return F.flatten(F.transform(few, lambda p: F.transform(p, bare)))


def parse_name(name, part: int) -> Column:
    """Part ``part`` (1 = rightmost) of a dotted name of at most four, possibly bracketed, parts.

    NULL when the part is absent or empty, or when there are more than four parts.
    """
    return F.get(name_parts(name), F.lit(part - 1))


def like_regex(pattern, literal_underscore: bool = True) -> Column:
    """An anchored, case-insensitive regular expression equivalent to a LIKE pattern.

    ``%`` matches anything and ``[...]`` classes stay active.  ``_`` is an ordinary character by
    default, because selection lists escape it.
    """
    text = as_col(pattern)
    steps = [
        # Regex metacharacters other than the class brackets are ordinary characters in LIKE.
        (r"([\\.^$|?*+(){}&])", r"\\$1"),
        # ... except ^ right after [, which negates the class.
        (r"\[\\\^", "[^"),
        # A bracket that is never closed is an ordinary character.
        (r"\[(?![^\]]+\])", r"\\["),
        # A class holding a single % or _ stands for that character.
        (r"\[%\]", r"\\x25"),
        (r"\[_\]", r"\\x5f"),
        ("%", ".*"),
    ]
    if not literal_underscore:
        steps.append(("_", "."))
    body = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)
    return concat_text(r"(?isu)\A", body, r"\z")


def one_case(name) -> Column:
    """A name with its letters in one case, each by itself, as case-insensitive patterns compare them."""
    text = as_col(name)

    def letter(c: Column) -> Column:
        upper = F.upper(c)
        upper = F.when(F.length(upper) == 1, upper).otherwise(c)
        lower = F.lower(upper)
        return F.when(F.length(lower) == 1, lower).otherwise(upper)

    each = F.array_join(F.transform(F.split(text, ""), letter), "")
    return F.when(F.rlike(text, F.lit(r"\A\p{ASCII}*\z")), F.lower(text)).otherwise(each)


def has_wildcard(pattern) -> Column:
    """Whether a selection pattern holds ``%``."""
    return as_col(pattern).contains("%")


def file_system_name(name) -> Column:
    """A name without the characters a file name cannot hold, right-trimmed."""
    return F.rtrim(F.translate(as_col(name), RESERVED_FILE_CHARACTERS, ""))


def hour_min_sec(seconds) -> Column:
    """``H hour(s), Mmin, S sec``."""
    s = as_col(seconds).cast("bigint")
    return F.concat(
        int_div(s, 3600).cast("string"),
        F.lit(" hour(s), "),
        int_div(s % 3600, 60).cast("string"),
        F.lit("min, "),
        (s % 60).cast("string"),
        F.lit(" sec"),
    )


def duration_text(seconds) -> Column:
    """``[d.]hh:mm:ss``; the day part is present only from 24 hours on."""
    s = as_col(seconds).cast("bigint")
    days = int_div(s, 86400)
    clock = F.concat_ws(
        ":",
        *[
            F.lpad(v.cast("string"), 2, "0")
            for v in (int_div(s % 86400, 3600), int_div(s % 3600, 60), s % 60)
        ],
    )
    prefix = F.when(days > 0, concat_text(days.cast("string"), ".")).otherwise(F.lit(""))
    return F.when(s.isNotNull(), F.concat(prefix, clock))


def statement_text(text, start, end) -> Column:
    """The statement between two byte offsets of a two-byte-per-character batch text.

    ``end = -1`` means up to the end of the text.  ``end`` is the offset of the last character.
    """
    body, first, last = as_col(text), as_col(start).cast("int"), as_col(end).cast("int")
    stop = F.coalesce(F.nullif(last, F.lit(-1)), F.length(body) * 2)
    return F.substring(
        body, int_div(first, 2).cast("int") + 1, int_div(stop - first, 2).cast("int") + 1
    )


def parent_pattern(path, suffix: str, separator: str = "\\") -> Column:
    """The folder of ``path`` followed by a file-name pattern."""
    sep = "\\\\" if separator == "\\" else separator
    return concat_text(F.regexp_replace(as_col(path), f"[^{sep}]*$", ""), suffix)

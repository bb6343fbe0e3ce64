"""Words of many texts at once, as spans of one byte buffer, and their XXH64 hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space between words: blank and 0x09-0x0D; other bytes belong to words.  A-Z become a-z.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)


@dataclass
class Words:
    """Words of a slice of texts: ``data`` holds them lower-cased with one blank behind each.

    ``data`` is padded, so 8 bytes can be read from any place.  ``first`` has, for each text and
    one beyond, the number of its first word.
    """

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()


def split_words(texts: Sequence[bytes]) -> Words:
    """Words of the texts, in order."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[raw]
    after = np.concatenate([[False], ~space[:-1]])
    kept = ~space | after  # of every run of white space behind a word, its first byte
    begins = ~space & ~after
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    word_count = np.concatenate([[0], np.cumsum(begins)])
    data = _LOWER[raw[kept]]
    data[space[kept]] = 32
    stops = np.flatnonzero(data == 32)
    start = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)
    first = np.concatenate([[0], word_count[ends]])
    data = np.concatenate([data, np.zeros(64, np.uint8)])
    return Words(data, start.astype(np.int64), stops - start, first)


def text_slices(column: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of about ``size`` bytes of a string column: first row and UTF-8 texts, null as empty."""
    rows: list[bytes] = []
    begin = held = 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        rows.append(value.as_py() or b"")
        held += len(rows[-1])
        if held >= size:
            yield begin, rows
            rows, begin, held = [], i + 1, 0
    if rows:
        yield begin, rows


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the spans of ``data`` (padded by 8 bytes at least)."""
    lanes = np.lib.stride_tricks.as_strided(
        data[: len(data) - 7].view(), shape=(len(data) - 7, 8), strides=(1, 1)
    )

    def read(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(lanes[at]).view("<u8").ravel()

    s = np.uint64(seed)
    out = np.full(len(start), s + _P5, dtype=np.uint64)
    stripes = length // 32
    with np.errstate(over="ignore"):
        big = np.flatnonzero(stripes)
        if len(big):
            zero = np.zeros(len(big), np.uint64)
            acc = [zero + v for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for n in range(int(stripes.max())):
                on = np.flatnonzero(stripes[big] > n)
                at = start[big[on]] + 32 * n
                for j in range(4):
                    acc[j][on] = _round(acc[j][on], read(at + 8 * j))
            h = sum(_rotate(a, by) for a, by in zip(acc, (1, 7, 12, 18), strict=True))
            for a in acc:
                h = (h ^ _round(np.uint64(0), a)) * _P1 + _P4
            out[big] = h
        out += length.astype(np.uint64)
        at, rest = start + 32 * stripes, length % 32
        for n in range(3):
            on = np.flatnonzero(rest >= 8 * (n + 1))
            if len(on):
                h = out[on] ^ _round(np.uint64(0), read(at[on] + 8 * n))
                out[on] = _rotate(h, 27) * _P1 + _P4
        at = at + (rest & ~7)
        on = np.flatnonzero(rest & 4)
        h = out[on] ^ ((read(at[on]) & np.uint64(0xFFFFFFFF)) * _P1)
        out[on] = _rotate(h, 23) * _P2 + _P3
        at = at + (rest & 4)
        for n in range(3):
            on = np.flatnonzero((rest & 3) > n)
            h = out[on] ^ (data[at[on] + n].astype(np.uint64) * _P5)
            out[on] = _rotate(h, 11) * _P1
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    return out


def batch_slices(batch: pa.RecordBatch, column: int, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of a string column, in order; none of an empty batch."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(length, dtype=np.int64) // size, prepend=-1)).tolist() + [len(length)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(begin, end - begin)

"""Bounded samples by hash: the same rows on every run, whatever the size of the table."""

from __future__ import annotations

_LOWEST = -(2**63)


def hash_limit(most: int, count: int) -> int:
    """The greatest ``xxhash64`` (signed) that is drawn, so that about ``most`` of ``count`` rows are.

    All 64 bits of the hash take part, so no table is too large for a row to be drawn.
    """
    if count <= most:
        return 2**63 - 1
    return max(_LOWEST, _LOWEST + most * 2**64 // count - 1)

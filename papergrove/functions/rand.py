"""Draws that depend on nothing but seed, id and purpose, so any partitioning or retry gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One more than the largest 32-bit draw.
SPAN = 4294967296


def _digest(seed: int, ident: Column, tags: tuple[Column | str, ...]) -> Column:
    parts = [F.lit(str(seed)), F.lit(":"), ident.cast("string"), F.lit(":")]
    return F.md5(F.concat(*parts, *[F.lit(t) if isinstance(t, str) else t.cast("string") for t in tags]))


def h32(seed: int, ident: Column, *tags: Column | str) -> Column:
    """An integer in [0, 2**32): the first eight digits of md5(seed:id:tag)."""
    return F.conv(F.substring(_digest(seed, ident, tags), 1, 8), 16, 10).cast("long")


def uniform(seed: int, ident: Column, *tags: Column | str) -> Column:
    """A double in (0, 1]."""
    return (h32(seed, ident, *tags) + 1).cast("double") / F.lit(float(SPAN))


def h60(seed: int, ident: Column, *tags: Column | str) -> Column:
    """An integer in [0, 2**60): the first fifteen digits of the same md5."""
    return F.conv(F.substring(_digest(seed, ident, tags), 1, 15), 16, 10).cast("long")


def pick(seed: int, ident: Column, n: Column | int, *tags: Column | str) -> Column:
    """An integer in [0, n), for any n that a table can hold."""
    return F.pmod(h60(seed, ident, *tags), F.lit(n) if isinstance(n, int) else n)

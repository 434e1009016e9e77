"""Joins to a table of sized keys in which a few hot keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A hot key has at least ``LEAST`` rows and at least one in ``MOST`` of all rows, so there are at most ``MOST`` of them.
LEAST, MOST = 256, 1 << 16


def hot_bar(small: DataFrame, size: str, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """From how many rows on a key of ``small`` is hot, and how many are: never more than ``most``, whatever the input."""
    total, top = small.agg(F.coalesce(F.sum(size), F.lit(0)), F.max(size)).first()
    bar = max(least, -(-int(total) // most))
    return bar, 0 if top is None or top < bar else small.where(F.col(size) >= bar).count()


def split_join(big: DataFrame, small: DataFrame, on: list[str], size: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The inner join of ``big`` with ``small``, which is unique by ``on`` and tells in ``size`` how many rows of ``big`` a key has.

    Rows of hot keys are joined where they lie, with a broadcast of at most ``most`` rows of ``small``; only the others
    are shuffled. Rows with a null key join nothing. ``small`` is read several times, so it should be a written table.
    """
    bar, hot = hot_bar(small, size, least, most)
    if not hot:
        return big.join(small, on)
    heavy, light = small.where(F.col(size) >= bar), small.where(F.col(size) < bar)
    rest = big.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return big.join(F.broadcast(heavy), on).unionByName(rest)

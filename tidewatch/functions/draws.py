"""Seeded draw order: the same for every engine, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *parts: Column | str) -> Column:
    """A hex string that puts rows into a random order fixed by ``seed`` and their key."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))

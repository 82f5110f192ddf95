"""Rows dealt by key to as many tasks as they need, so that what one task holds does not grow with the table.

Adaptive execution merges partitions by their compressed size, and rows that compress well come to many in one task; a number of partitions that is asked for stays. What is dealt by some keys needs no
other shuffle for windows, aggregates and joins on these and further keys, if both sides of a join have the same number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(rows: DataFrame, each: int, weight: Column | None = None) -> int:
    """How many parts of about `each` rows (or of that sum of weights) there are, 1 at least. A job of its own over `rows`; of a plain table it reads the row counts only."""
    total = rows.count() if weight is None else rows.agg(F.sum(weight)).first()[0]
    return max(1, -(-int(total or 0) // each))


def spread(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows in n parts by hash of keys. All rows of a key are in one part, so a key must not have more than a task can sort."""
    return rows.repartition(n, *keys)

"""Numeric and sequence scores as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_bucket(v: Column) -> Column:
    """0 for 0, 1 under 2, else floor(log2) + 1, 63 at most, of the absolute value."""
    a = F.abs(v)
    return F.when(a == 0, 0).when(a < 2, 1).otherwise(F.least(F.floor(F.log2(a.cast("double"))) + 1, F.lit(63))).cast("int")


def safe_float(v: Column, otherwise: float = 0.0) -> Column:
    x = v.try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(otherwise)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a over b, b counting as 1 at least."""
    return a / F.greatest(F.lit(1), b)


def count_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.lit(1), b))


def js_divergence(p: Column, q: Column, floor: float = 1e-8) -> Column:
    """Jensen-Shannon divergence (natural logarithm) of two arrays of shares, each value at least `floor`."""
    a, b = (F.transform(x, lambda v: F.greatest(v.cast("double"), F.lit(floor))) for x in (p, q))
    term = lambda x, m: x * F.log(x / m)
    both = F.zip_with(a, b, lambda x, y: 0.5 * term(x, (x + y) / 2) + 0.5 * term(y, (x + y) / 2))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def _numbered(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Elements as numbers, equal for equal elements; nulls equal no other."""
    seen: dict = {}
    return tuple(np.array([seen.setdefault(x, len(seen)) if x is not None else -1 - side for x in (v if v is not None else ())], np.int64) for side, v in enumerate((a, b)))  # type: ignore[return-value]


def lcs(a, b) -> int:
    """Longest common subsequence, one row of the table of prefixes at a time: rows only rise, so a running maximum fills one."""
    x, y = _numbered(a, b)
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return int(row[-1])


def distance(a, b) -> int:
    """Edit distance, likewise: insertions are a running minimum along a slope of one."""
    x, y = _numbered(a, b)
    slope = np.arange(len(y) + 1)
    row = slope.copy()
    for k, v in enumerate(x):
        new = np.concatenate([[k + 1], np.minimum(row[1:] + 1, row[:-1] + (y != v))])
        row = np.minimum.accumulate(new - slope) + slope
    return int(row[-1])


def _pairwise(kernel: Callable[..., int], a: str, b: str) -> Column:
    @F.pandas_udf("bigint")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([kernel(i, j) for i, j in zip(x, y, strict=True)], dtype="int64")

    return run(F.col(a), F.col(b))


def lcs_length(a: str, b: str) -> Column:
    """Longest common subsequence of two array columns (null: empty)."""
    return _pairwise(lcs, a, b)


def lcs_f1(a: str, b: str) -> Column:
    """2 * common / (both lengths); both empty: 1."""
    n = F.coalesce(F.size(a), F.lit(0)) + F.coalesce(F.size(b), F.lit(0))
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / n)


def sequence_distance(a: str, b: str) -> Column:
    """Edit distance of two array columns (null: empty), over elements."""
    return _pairwise(distance, a, b)


def document_quality(outline: Column, kinds: Column, controls: Column, slots: Column, valid: Column, fallback: Column, gotos: Column, n_slots: Column) -> Column:
    """Weighted likeness less a penalty for size (0.25 at most); a candidate that isn't valid loses 1."""
    # fixed values: the weights
    penalty = F.least(F.lit(0.25), 0.01 * fallback + 0.008 * gotos + 0.002 * n_slots)
    return 0.42 * outline + 0.22 * kinds + 0.14 * controls + 0.12 * slots + F.when(valid, 0.1).otherwise(-1.0) - penalty


def structural_reward(divergence: Column, distance: Column, longest: Column, depth_a: Column, depth_b: Column) -> Column:
    """0.4 * likeness of distributions + 0.4 * likeness of sequences + 0.2 * likeness of depths."""
    deep = F.greatest(depth_a, depth_b, F.lit(1))
    return 0.4 * (1 - divergence) + 0.4 * (1 - distance / F.greatest(longest, F.lit(1))) + 0.2 * (1 - F.abs(depth_a - depth_b) / deep)


def combined_reward(compiles: Column, structure: Column, meaning: Column) -> Column:
    return 0.2 * compiles + 0.5 * structure + 0.3 * meaning

"""Filters that say why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_reasons(df: DataFrame, rules: list[tuple[str, Column, int]], corrupt: Column | None = None) -> DataFrame:
    """Add `reason`: the first (name, size, cap) whose size is over its cap, `unparsable` before all of them, else `kept`."""
    out = F.lit("kept")
    for name, size, cap in reversed(rules):
        out = F.when(F.coalesce(size, F.lit(0)) > cap, F.lit(name)).otherwise(out)
    if corrupt is not None:
        out = F.when(corrupt, F.lit("unparsable")).otherwise(out)
    return df.withColumn("reason", out)


def all_equal(array: str, value: int) -> Column:
    """Whether an array has elements and all equal value; a null or empty array: false."""
    return F.coalesce((F.size(array) > 0) & F.forall(array, lambda x: x == value), F.lit(False))


def strict_validity(flags: list[str]) -> Column:
    """All flags true; a null flag counts as false."""
    out = F.lit(True)
    for f in flags:
        out = out & F.coalesce(F.col(f), F.lit(False))
    return out


def fits_lines(low: Column, high: Column, n_lines: Column, slack: int = 20) -> Column:
    """Whether a line range lies in a file of n lines, some slack behind its end allowed."""
    return (low >= 1) & (high <= n_lines + slack)


def forbid_columns(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """Fail if a column that would leak labels is among the features."""
    if bad := sorted(forbidden & set(df.columns)):
        raise ValueError(f"leaking features: {', '.join(bad)}")
    return df


def without_tier(df: DataFrame, column: str, dropped: str = "line_fallback", keep: bool = False) -> DataFrame:
    """Rows that are not of a tier, all rows with `keep`; rows without a tier stay."""
    return df if keep else df.where(~F.col(column).eqNullSafe(F.lit(dropped)))


def inside(address: Column, size: Column, base: Column, length: Column) -> Column:
    """Whether [address, address + size) lies in [base, base + length)."""
    return (address - base >= 0) & (address - base + size <= length)


def c_family(path: Column) -> Column:
    """Whether a path's suffix is that of C or C++ sources or headers; a name that is a suffix alone has none. A null path: false."""
    return F.coalesce(F.rlike(path, F.lit(r"[^/]\.(c|h|hpp|cpp)$")), F.lit(False))


def enough_evidence(n_blocks: Column, mean_conf: Column, least_blocks: int, least_conf: float | None = None) -> Column:
    """At least so many blocks and, if asked for, such a mean confidence (null: 0)."""
    out = F.coalesce(n_blocks, F.lit(0)) >= least_blocks
    return out if least_conf is None else out & (F.coalesce(mean_conf, F.lit(0.0)) >= least_conf)


def training_references(refs: str, tier: Callable[[Column], Column], least: int) -> Column:
    """Of an array of structs (confidence_level, weight, ...) those of at least a tier's rank and a positive weight, with `normalized_weight` (8 places); null if none is left."""
    kept = F.filter(refs, lambda r: (tier(F.coalesce(r["confidence_level"], F.lit("C0"))) >= least) & (F.coalesce(r["weight"], F.lit(0.0)) > 0))
    total = F.aggregate(kept, F.lit(0.0), lambda s, r: s + r["weight"])
    named = F.transform(kept, lambda r: r.withField("normalized_weight", F.round(r["weight"] / total, 8)))
    return F.when(F.size(kept) > 0, named)


def within_cap(ids: str, cap: int | None) -> Column:
    """Whether a supervised row has ids, and no more than a cap; a null array: false."""
    n = F.coalesce(F.size(ids), F.lit(0))
    return (n > 0) if cap is None else (n > 0) & (n <= cap)


def of_primary_file(path: Column, relative: Column, primary: Column, primary_relative: Column) -> Column:
    """Whether a line's path or relative path is the primary file's; without any primary file all lines are."""
    same = lambda a, b: F.coalesce((b != "") & (a == b), F.lit(False))
    none = (F.coalesce(primary, F.lit("")) == "") & (F.coalesce(primary_relative, F.lit("")) == "")
    return none | same(path, primary) | same(relative, primary_relative)


def token_accuracy(predicted: str, labels: str, ignored: int = -100) -> Column:
    """Share of supervised places behind the first whose prediction is the label; 0 without any."""
    pairs = F.filter(F.slice(F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("l")), 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x["l"] != ignored)
    return F.coalesce(F.size(F.filter(pairs, lambda x: x["p"] == x["l"])) / F.nullif(F.size(pairs), F.lit(0)), F.lit(0.0))


def flattened_pairs(pairs: str) -> Column:
    """The elements of an array of arrays without nulls."""
    return F.array_compact(F.flatten(F.array_compact(pairs)))

"""Row identity, duplicates, and comparisons of key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import clean_path

#: How a row of a function dataset is identified. Policies differ in cleaning, in their fallback, and in what a missing key means.
POLICIES = ("dedup", "raw", "trimmed", "function_source", "uid")


def identity_key(policy: str, source: str = "source_file", binary: str = "binary", func: str = "func_name") -> Column:
    """The key of a row as a struct, null where the policy keeps a row without a usable key apart.

    dedup: cleaned source (else binary) and trimmed function; null if either is empty. raw: the same pair uncleaned, nulls as empty text.
    trimmed: trimmed pair; null if either is empty. function_source: function and source, no fallback. uid: source or binary, and function.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    filled = lambda a, b: F.when(a != "", a).otherwise(b)
    if policy == "dedup":
        a, b = filled(clean_path(text(source)), clean_path(text(binary))), F.trim(text(func))
    elif policy == "trimmed":
        a, b = filled(F.trim(text(source)), F.trim(text(binary))), F.trim(text(func))
    elif policy in ("raw", "uid"):
        a, b = filled(text(source), text(binary)), text(func)
    elif policy == "function_source":
        a, b = text(source), text(func)
    else:
        raise ValueError(f"unknown policy {policy}")
    key = F.struct(a.alias("where"), b.alias("name"))
    return F.when((a != "") & (b != ""), key) if policy in ("dedup", "trimmed") else key


def keep_one(df: DataFrame, keys: list[Column], order: Column, keep: str = "last") -> DataFrame:
    """One whole row per key, the last or first by `order`. An aggregate, so a frequent key is reduced on every task first."""
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(pick(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def dedup_summary(df: DataFrame, key: Column) -> DataFrame:
    """total, unique, extra and missing (rows whose key is null); one pass."""
    counts = df.groupBy(key.alias("_k")).agg(F.count("*").alias("c"))
    some = F.col("_k").isNotNull()
    return counts.agg(
        F.sum("c").alias("total"),
        F.count_if(some).alias("unique_keys"),
        F.coalesce(F.sum(F.when(some, F.col("c") - 1)), F.lit(0)).alias("extra"),
        F.coalesce(F.sum(F.when(~some, F.col("c"))), F.lit(0)).alias("missing"),
    )


def multiplicity_histogram(df: DataFrame, *keys: Column) -> DataFrame:
    """How many keys occur 1, 2, ... 9 or `10+` times, with the rows and the redundant rows they hold."""
    counts = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("c"))
    bucket = F.when(F.col("c") >= 10, F.lit("10+")).otherwise(F.col("c").cast("string"))
    return counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_keys"), F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("redundant"))


def top_key_diffs(df: DataFrame, key: str, order: str, fields: list[str], n: int) -> DataFrame:
    """The n most frequent keys, each with its first two rows compared field by field (null-safe); n is a report's length."""
    first_two = F.slice(F.sort_array(F.collect_set(F.struct(order, *fields))), 1, 2)
    top = df.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1").orderBy(F.desc("copies"), key).limit(n)
    # of a key only its two smallest orders are gathered
    low = df.join(F.broadcast(top), key).groupBy(key, "copies").agg(F.min(order).alias("_a"))
    second = df.join(F.broadcast(low), key).where(F.col(order) > F.col("_a")).groupBy(key, "_a", "copies").agg(F.min(order).alias("_b"))
    pair = df.join(F.broadcast(second), key).where((F.col(order) == F.col("_a")) | (F.col(order) == F.col("_b")))
    pair = pair.groupBy(key, "copies").agg(first_two.alias("_p")).where("size(_p) = 2")
    differ = F.array_compact(F.array(*[F.when(~F.col("_p")[0][f].eqNullSafe(F.col("_p")[1][f]), F.lit(f)) for f in fields]))
    return pair.select(key, "copies", F.col("_p")[0][order].alias("first_row"), F.col("_p")[1][order].alias("second_row"), F.array_join(differ, ",").alias("differing"))


def keys_on_all_levels(df: DataFrame, key: str, level: str, n_levels: int) -> DataFrame:
    """Keys that occur on every one of n levels."""
    return df.groupBy(key).agg(F.count_distinct(level).alias("_n")).where(F.col("_n") == n_levels).select(key)


def level_diff(a: DataFrame, b: DataFrame, key: str, payload: str) -> DataFrame:
    """Full outer comparison of two levels whose keys are unique: counts of both, only a, only b, same and different payloads."""
    x = a.select(F.col(key).alias("_k"), F.sha2(F.to_json(F.struct(payload)), 256).alias("_a"))
    y = b.select(F.col(key).alias("_k"), F.sha2(F.to_json(F.struct(payload)), 256).alias("_b"))
    state = (
        F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("_a") == F.col("_b"), "same").otherwise("different")
    )
    return x.join(y, "_k", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def prefix_unions(df: DataFrame, rank: str, stages: list[str]) -> DataFrame:
    """Stage s holds every row whose level rank is at most s."""
    spark = df.sparkSession
    names = spark.createDataFrame([(k, s) for k, s in enumerate(stages)], "stage_rank int, stage string")
    return df.join(F.broadcast(names), F.col(rank) <= F.col("stage_rank"))  # as many stages as the caller lists


def leakage(train: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of `other` whose key also occurs in `train`."""
    return other.join(train.select(key).distinct(), key, "left_semi")


def unique_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once."""
    once = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return df.join(once, key, "left_semi")


def all_rows(frames: list[DataFrame]) -> DataFrame:
    """Plain concatenation by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def of_projects(df: DataFrame, name: str, pattern: str, groups: dict[str, int], projects: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Rows of files whose name has a pattern, with the pattern's groups as columns; `project` must be one of them. Only listed projects, and none that is excluded; a null name drops out."""
    out = df.where(F.rlike(name, F.lit(pattern))).withColumns({g: F.regexp_extract(name, pattern, k) for g, k in groups.items()})
    if projects is not None:
        out = out.where(F.col("project").isin(projects))
    return out.where(~F.col("project").isin(excluded)) if excluded else out

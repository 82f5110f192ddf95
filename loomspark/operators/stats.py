"""Report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tenths_histogram(df: DataFrame, value: str) -> DataFrame:
    """Ten bins [k / 10, (k + 1) / 10); 1.0 belongs to the last. A value counts in the first bin whose upper bound is over it. Values outside 0 to 1 count in no bin."""
    v = F.col(value)
    bin_ = F.lit(9)
    for k in reversed(range(9)):
        bin_ = F.when(v < (k + 1) / 10, k).otherwise(bin_)
    return df.where((v >= 0) & (v <= 1)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at place floor(n / 2) from 0: of an even number the larger of the two in the middle. Equal values are counted before they are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    counts = counts.withColumns({"_to": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    return counts.where(F.col("_to") > F.floor(F.col("_n") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"), F.first("_n").alias("n"))


def totals(df: DataFrame, by: str, sums: list[str], label: str = "TOTAL") -> DataFrame:
    """Sums by a column with a TOTAL row (an empty table has none); percentages of the first over the second sum, null for none."""
    out = df.rollup(by).agg(*[F.sum(s).alias(s) for s in sums], F.grouping(by).alias("_g"))
    out = out.withColumn(by, F.when(F.col("_g") == 1, label).otherwise(F.col(by).cast("string")))
    return out.withColumn("percent", F.round(100 * F.col(sums[0]) / F.nullif(F.col(sums[1]), F.lit(0)), 6)).drop("_g")


def most_common(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values (ties by value) and `__other__` for the rest."""
    counts = df.groupBy(F.col(key).cast("string").alias("name")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "name").limit(k)
    rest = counts.join(F.broadcast(top.select("name")), "name", "left_anti").agg(F.lit("__other__").alias("name"), F.sum("n").alias("n")).where("n IS NOT NULL")
    return top.unionByName(rest)


def macro_average(df: DataFrame, sample: list[str], by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Metrics per sample, then their plain mean over the samples of each group."""
    per = df.groupBy(*by, *sample).agg(*[c.alias(n) for n, c in metrics.items()])
    return per.groupBy(*by).agg(F.count("*").alias("n_samples"), *[F.round(F.avg(n), 6).alias(n) for n in metrics])


def calibration(per_sample: DataFrame, weight: str, metrics: list[str]) -> DataFrame:
    """Over samples, by their mean weight: the number and the mean of each metric where it is high (0.7 or more) and middling (0.3 to 0.7). A band without samples has null means."""
    w = F.col(weight)
    band = F.when(w >= 0.7, "high").when((w >= 0.3) & (w < 0.7), "middling")
    return per_sample.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def baseline_delta(df: DataFrame, by: str, level: str, base: str, value: str) -> DataFrame:
    """A value less the value of the base level in the same group; null without one. Rows are one per group and level."""
    baseline = df.where(F.col(level) == base).select(by, F.col(value).alias("_base"))
    return df.join(baseline, by, "left").withColumn("delta", F.round(F.col(value) - F.col("_base"), 6)).drop("_base")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation of each column, a deviation of 0 counting as 1."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(s))  # one row
    for c in columns:
        out = out.withColumn(f"z_{c}", F.round((F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)), 6))
    return out.drop(*s.columns)


def shares(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Counts of key in each group and their share of it."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6))


def cumulative(df: DataFrame, order: str) -> DataFrame:
    """Counts of each value of a short ordered column, and their running sum."""
    counts = df.groupBy(order).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy(order)))


# By metric the closed interval that is expected (null: open), and the least value that comes near.
BANDS = {"coverage": (0.90, 0.95, 0.85), "high_confidence": (0.75, 0.85, 0.60), "agreement": (0.85, 0.90, 0.75), "order": (0.90, None, 0.85)}


def verdict(metric: str, value: Column) -> Column:
    """ok in the expected interval of a metric, near from its lower bound on (over the interval, too), else miss; null for no value."""
    low, high, near = BANDS[metric]
    inside = value >= low if high is None else (value >= low) & (value <= high)
    return F.when(value.isNull(), F.lit(None).cast("string")).when(inside, "ok").when(value >= near, "near").otherwise("miss")

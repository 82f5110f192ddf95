"""Values of alignment losses on given vectors, as joins and grouped sums. Pair tables are sparse; similarity rows are bounded by one function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarities(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, tau: float) -> DataFrame:
    """(on, a, b, sim): the rows of a function's two sides, their inner product over tau. Joined on the function."""
    pairs = left.select(*on, a, F.col("v").alias("_x")).join(right.select(*on, b, F.col("v").alias("_y")), on)
    return pairs.select(*on, a, b, (dot("_x", "_y") / tau).alias("sim"))


def log_softmax(sim: DataFrame, row: list[str]) -> DataFrame:
    """Add `lp`: the similarity less the log of the row's summed exponents, shifted by the row's largest."""
    top = sim.groupBy(*row).agg(F.max("sim").alias("_m"))
    z = sim.join(top, row).groupBy(*row).agg((F.max("_m") + F.log(F.sum(F.exp(F.col("sim") - F.col("_m"))))).alias("_z"))
    return sim.join(z, row).withColumn("lp", F.col("sim") - F.col("_z")).drop("_z")


def multi_positive(sim: DataFrame, on: list[str], a: str) -> DataFrame:
    """Mean over all rows of -(mean log softmax of the positives); a row without positives adds 0 but counts. `pos` marks positives."""
    per = log_softmax(sim, [*on, a]).groupBy(*on, a).agg(F.coalesce(-F.avg(F.when(F.col("pos"), F.col("lp"))), F.lit(0.0)).alias("l"))
    return per.groupBy(*on).agg(F.round(F.avg("l"), 6).alias("loss"))


def neighbour_reconstruction(sim: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """Mean -log softmax of edges (on, src, dst) over a graph's other nodes (sim: on, src, dst, sim); loops do not count."""
    lp = log_softmax(sim.where("src <> dst"), [*on, "src"])
    hit = edges.where("src <> dst").join(lp, [*on, "src", "dst"])
    return hit.groupBy(*on).agg(F.round(-F.avg("lp"), 6).alias("loss"))


def plan_error(sim: DataFrame, target: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Mean squared difference of a row's softmax and its normalised target mass (on, a, b, m)."""
    t = target.join(target.groupBy(*on, a).agg(F.sum("m").alias("_s")), [*on, a]).select(*on, a, b, (F.col("m") / F.greatest(F.col("_s"), F.lit(1e-8))).alias("t"))
    x = log_softmax(sim, [*on, a]).join(t, [*on, a, b], "left")
    return x.groupBy(*on).agg(F.round(F.avg(F.pow(F.exp("lp") - F.coalesce("t", F.lit(0.0)), F.lit(2))), 6).alias("loss"))


def hard_negative_rows(sim: DataFrame, on: list[str], a: str, b: str, k: int) -> DataFrame:
    """-log(positives / (positives + the k largest negatives)) of rows by a and of columns by b that have both, and their mean per function with their number."""

    def along(anchor: str) -> DataFrame:
        both = sim.groupBy(*on, F.col(anchor).alias("_anchor"), F.lit(anchor).alias("_side")).agg(
            F.collect_list(F.when(F.col("pos"), F.col("sim"))).alias("p"),
            F.slice(F.sort_array(F.collect_list(F.when(~F.col("pos"), F.col("sim"))), asc=False), 1, k).alias("n"),
        )
        rows = both.where("size(p) > 0 AND size(n) > 0").withColumn("m", F.greatest(F.array_max("p"), F.array_max("n")))
        total = lambda c: F.aggregate(F.transform(c, lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda s, x: s + x)
        return rows.select(*on, (F.log(total("p") + total("n")) - F.log(total("p"))).alias("l"))

    return along(a).unionByName(along(b)).groupBy(*on).agg(F.round(F.avg("l"), 6).alias("loss"), F.count("*").alias("n_rows"))


def count_error(predicted: Column, actual: Column) -> Column:
    return F.avg(F.pow(predicted - actual, F.lit(2)))


def pattern_reliability(probability: str, header: Column, bad: Column, nodes: Column, header_weight: float = 2.0, tree_weight: float = 1.0) -> Column:
    """Aggregate over blocks: sqrt(s_pat * s_tree ** weight); s_pat the weighted geometric mean of the largest shares, headers counting more, s_tree 1 - bad / nodes."""
    w = F.when(header, header_weight).otherwise(1.0)
    s_pat = F.exp(F.sum(F.log(F.greatest(F.col(probability), F.lit(1e-6))) * w) / F.sum(w))
    s_tree = F.greatest(F.lit(0.0), 1 - F.first(bad) / F.greatest(F.lit(1), F.first(nodes)))
    return F.sqrt(F.least(F.greatest(s_pat, F.lit(0.0)), F.lit(1.0)) * F.pow(s_tree, F.lit(tree_weight)))

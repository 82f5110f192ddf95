"""Soft alignments as sparse cells: sample, b (block), s (statement), m (mass), w (confidence). Cells of one (sample, b, s) are unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_normalised(cells: DataFrame, sample: str = "sample") -> DataFrame:
    """Each block's masses divided by their sum; a block of no mass stays."""
    total = F.sum("m").over(Window.partitionBy(sample, "b"))
    return cells.withColumn("m", F.coalesce(F.col("m") / F.nullif(total, F.lit(0.0)), F.col("m")))


def weights_normalised(df: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Negative weights count as 0; shares are rounded to 8 places; a group whose total is not positive stays."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    total = F.sum(w).over(Window.partitionBy(*by))
    return df.withColumn(weight, F.when(total > 0, F.round(w / total, 8)).otherwise(F.col(weight)))


def primary(cells: DataFrame, sample: str = "sample", least: float = 0.0) -> DataFrame:
    """Each block's statement of most mass, over `least`; of equal masses the smallest statement."""
    best = cells.where(F.col("m") > least).groupBy(sample, "b").agg(F.max_by(F.struct("s", "m", "w"), F.struct("m", (-F.col("s")).alias("k"))).alias("_x"))
    return best.select(sample, "b", "_x.s", "_x.m", "_x.w")


def top_by_peak(cells: DataFrame, sample: str = "sample", share: float = 0.5, k: int = 3, least: float = 0.0) -> DataFrame:
    """Of each block the k largest cells that reach a share of its largest; of equal masses the larger statement first."""
    w = Window.partitionBy(sample, "b")
    rows = cells.withColumn("_peak", F.max("m").over(w)).where((F.col("m") >= F.greatest(F.lit(least), F.col("_peak") * share)) & (F.col("m") > 0))
    return rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("m"), F.desc("s")))).where(F.col("place") <= k).drop("_peak")


def order_pairs(placed: DataFrame, sample: str = "sample") -> DataFrame:
    """Steps from each aligned block to the next block number, where that is aligned too: `step` is the move in statements."""
    nxt = placed.select(sample, (F.col("b") - 1).alias("b"), F.col("s").alias("_s"))
    return placed.join(nxt, [sample, "b"]).select(sample, "b", (F.col("_s") - F.col("s")).alias("step"))


def control_flow_share(placed: DataFrame, edges: DataFrame, sample: str = "sample") -> DataFrame:
    """Per sample with a conditional edge (sample, src, dst, etype 0) between aligned blocks: the share whose ends stand for different statements."""
    a, b = placed.select(sample, F.col("b").alias("src"), F.col("s").alias("_s")), placed.select(sample, F.col("b").alias("dst"), F.col("s").alias("_d"))
    ends = edges.where("etype = 0").join(a, [sample, "src"]).join(b, [sample, "dst"])
    return ends.groupBy(sample).agg(F.avg((F.col("_s") != F.col("_d")).cast("double")).alias("control_flow"))


def metrics(cells: DataFrame, n_blocks: DataFrame, edges: DataFrame | None = None, sample: str = "sample") -> DataFrame:
    """Per sample of n_blocks (sample, n_b): coverage, mean confidence of cells that have some, shares over 0.7 and under 0.3, order consistency, and with edges control-flow consistency.

    A step back of more than 2 breaks the order; without steps it holds, and so does the control flow without conditional edges. Without cells coverage and confidence are 0.
    """
    w = F.col("w")
    some = F.nullif(F.count_if(w > 0), F.lit(0))
    per = cells.groupBy(sample).agg(
        F.count_distinct(F.when(F.col("m") > 0, F.col("b"))).alias("covered"),
        F.avg(F.when(w > 0, w)).alias("mean_conf"),
        (F.count_if(w > 0.7) / some).alias("high"),
        (F.count_if((w > 0) & (w < 0.3)) / some).alias("low"),
    )
    placed = primary(cells, sample)
    steps = order_pairs(placed, sample).groupBy(sample).agg(F.avg((F.col("step") >= -2).cast("double")).alias("in_order"))
    out = n_blocks.join(per, sample, "left").join(steps, sample, "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    one = lambda c: F.round(F.coalesce(c, F.lit(1.0)), 6).alias(c)
    columns = [sample, zero(F.col("covered") / F.col("n_b")).alias("coverage"), *[zero(F.col(c)).alias(c) for c in ("mean_conf", "high", "low")], one("in_order")]
    if edges is not None:
        out = out.join(control_flow_share(placed, edges, sample), sample, "left")
        columns.append(one("control_flow"))
    return out.select(*columns)


def row_shapes(cells: DataFrame, n_blocks: DataFrame, sample: str = "sample", least: float = 0.01) -> DataFrame:
    """Shares of blocks with one, several or no cell over `least`."""
    per = cells.where(F.col("m") > least).groupBy(sample, "b").agg(F.count("*").alias("k"))
    per = per.groupBy(sample).agg(F.count_if(F.col("k") == 1).alias("one"), F.count_if(F.col("k") > 1).alias("many"))
    out = n_blocks.join(per, sample, "left").na.fill(0, ["one", "many"])
    share = lambda c: F.round(c / F.greatest(F.lit(1), F.col("n_b")), 6)
    return out.select(sample, share(F.col("one")).alias("one_hot"), share(F.col("many")).alias("multi"), share(F.col("n_b") - F.col("one") - F.col("many")).alias("empty"))


def jumps(placed: DataFrame, sample: str = "sample") -> DataFrame:
    """Steps back of more than 2, and the longest step, per sample with a step."""
    return order_pairs(placed, sample).groupBy(sample).agg(F.count_if(F.col("step") < -2).alias("n_jumps"), F.max(F.abs("step")).alias("longest"))


def compacted(cells: DataFrame, sample: str = "sample", least: float = 0.001) -> DataFrame:
    """Drop statements that no block gives more than `least`, and number the others from 0 in their order."""
    used = cells.groupBy(sample, "s").agg(F.max("m").alias("_m")).where(F.col("_m") > least)
    used = used.select(sample, "s", (F.dense_rank().over(Window.partitionBy(sample).orderBy("s")) - 1).alias("column"))
    return cells.join(used, [sample, "s"])


def expected_position(cells: DataFrame, sample: str = "sample") -> DataFrame:
    """Mean statement of each block, weighted by mass; null for a block of no mass."""
    mean = F.sum(F.col("s") * F.col("m")) / F.nullif(F.sum("m"), F.lit(0.0))
    return cells.groupBy(sample, "b").agg(F.round(mean, 6).alias("position"))


#: The counters of how two signals meet.
KINDS = ["agree", "near", "conflict", "first_only", "second_only", "none"]


def signal_kinds(signals: DataFrame) -> DataFrame:
    """Add `kind` to blocks with two signals (first, second: statements or null; first_start, first_end, second_start, second_end: their lines).

    near: their lines overlap or begin at most 2 apart.
    """
    near = ((F.col("first_start") <= F.col("second_end")) & (F.col("second_start") <= F.col("first_end"))) | (F.abs(F.col("first_start") - F.col("second_start")) <= 2)
    a, b = F.col("first"), F.col("second")
    both = F.when(a == b, "agree").when(near, "near").otherwise("conflict")
    return signals.withColumn("kind", F.when(a.isNotNull() & b.isNotNull(), both).when(a.isNotNull(), "first_only").when(b.isNotNull(), "second_only").otherwise("none"))


def fused(signals: DataFrame, sample: str = "sample") -> DataFrame:
    """Cells (sample, b, s, m, w) of blocks with two signals and their confidences (first_conf, second_conf).

    Agreeing or near signals give the first one's statement with the sum of both confidences, 1 at most (near: times 0.85); a conflict gives both, 0.6 and 0.4
    of the mass with half of their confidences; a single signal has 0.8 of its own.
    """
    a, b, sum_ = F.col("first_conf"), F.col("second_conf"), F.least(F.col("first_conf") + F.col("second_conf"), F.lit(1.0))
    cell = lambda s, m, w: F.struct(F.col(s).alias("s"), F.lit(m).alias("m"), w.cast("double").alias("w"))
    kind = F.col("kind")
    cells = (
        F.when(kind == "agree", F.array(cell("first", 1.0, sum_))).when(kind == "near", F.array(cell("first", 1.0, sum_ * 0.85)))
        .when(kind == "conflict", F.array(cell("first", 0.6, a * 0.5), cell("second", 0.4, b * 0.5)))
        .when(kind == "first_only", F.array(cell("first", 1.0, a * 0.8))).when(kind == "second_only", F.array(cell("second", 1.0, b * 0.8)))
    )
    return signal_kinds(signals).select(sample, "b", F.explode(cells).alias("_x")).select(sample, "b", "_x.*")


def signal_stats(signals: DataFrame, sample: str = "sample") -> DataFrame:
    """Per sample how many blocks have both signals, and how many are of each kind."""
    kind = F.col("kind")
    return signal_kinds(signals).groupBy(sample).agg(F.count_if(kind.isin("agree", "near", "conflict")).alias("n_both"), *[F.count_if(kind == k).alias(f"n_{k}") for k in KINDS])


def fused_lines(first: Column, second: Column, similarity: Column) -> Column:
    """Lines of a block and their confidence out of two arrays of lines and the similarity of the blocks they come from: struct(lines, confidence).

    Equal sets: 0.7 + 0.3 * similarity (1 at most); half of the first or more in common: what is common, by its share of the larger set; else the second, 0.5 + 0.3 * similarity;
    one side alone: 0.8 for the first, 0.6 + 0.2 * similarity for the second. Null arrays are empty.
    """
    clean = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<bigint>")))))
    a, b, z = clean(first.cast("array<bigint>")), clean(second.cast("array<bigint>")), F.coalesce(similarity, F.lit(0.0))
    both = F.array_sort(F.array_intersect(a, b))
    made = lambda lines, c: F.struct(lines.alias("lines"), c.cast("double").alias("confidence"))
    return (
        F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(a == b, made(a, F.least(F.lit(1.0), 0.7 + z * 0.3)))
            .when((F.size(both) > 0) & (F.size(both) >= F.size(a) * 0.5), made(both, F.size(both) / F.greatest(F.size(a), F.size(b)))).otherwise(made(b, 0.5 + z * 0.3)))
        .when(F.size(a) > 0, made(a, F.lit(0.8))).when(F.size(b) > 0, made(b, 0.6 + z * 0.2)).otherwise(made(a, F.lit(None)))
    )


def supported_lines(lines: DataFrame, cells: DataFrame, sample: str = "sample", least: float = 1e-12) -> DataFrame:
    """Lines (sample, b, ...) of blocks whose masses sum to more than `least`; samples without any cell keep theirs."""
    mass = cells.groupBy(sample, "b").agg((F.sum("m") > least).alias("_ok"))
    some = cells.select(sample).distinct().withColumn("_some", F.lit(True))
    out = lines.join(mass, [sample, "b"], "left").join(some, sample, "left")
    return out.where(F.coalesce("_ok", F.lit(False)) | F.col("_some").isNull()).drop("_ok", "_some")


def lines_consistent(lines: DataFrame, cells: DataFrame, samples: DataFrame, sample: str = "sample") -> DataFrame:
    """Per sample of samples: false if a block has lines but no mass."""
    held = cells.where("m > 0").select(sample, "b").distinct()
    bad = lines.select(sample, "b").distinct().join(held, [sample, "b"], "left_anti").select(sample).distinct().withColumn("_bad", F.lit(True))
    return samples.select(sample).distinct().join(bad, sample, "left").select(sample, F.col("_bad").isNull().alias("consistent"))


def weighted_kl(cells: DataFrame, predicted: DataFrame, shapes: DataFrame, sample: str = "sample", floor: float = 1e-8) -> DataFrame:
    """Per sample of shapes (sample, n_b, n_s) the mean over blocks of the sum of w * m log(m / p), w the cell's own confidence.

    Rows of both sides are shares of their sums; a block of cells without a prediction is compared with 1 / n_s. Values under the floor count as the floor; cells that are not
    stored have confidence 0 and add nothing.
    """
    total = lambda df, c, name: df.groupBy(sample, "b").agg(F.sum(c).alias(name))
    rows = cells.where("w > 0").join(total(cells, "m", "_mg"), [sample, "b"])
    rows = rows.join(predicted.select(sample, "b", "s", F.col("m").alias("p")), [sample, "b", "s"], "left").join(total(predicted, "m", "_mp"), [sample, "b"], "left").join(shapes, sample)
    share = lambda c, s: F.greatest(F.when(F.coalesce(s, F.lit(0.0)) > floor, F.coalesce(c, F.lit(0.0)) / s).otherwise(1 / F.col("n_s")), F.lit(floor))
    g, p = share(F.col("m"), F.col("_mg")), share(F.col("p"), F.col("_mp"))
    per = rows.groupBy(sample).agg(F.sum(F.col("w") * g * (F.log(g) - F.log(p))).alias("_kl"))
    return shapes.join(per, sample, "left").select(sample, F.round(F.coalesce("_kl", F.lit(0.0)) / F.greatest(F.col("n_b"), F.lit(1)), 6).alias("loss"))


def edge_recovery(cells: DataFrame, edges: DataFrame, source_edges: DataFrame, sample: str = "sample", floor: float = 1e-8, cap: float = 1e3) -> DataFrame:
    """KL of the statement edges against block edges carried over by the alignment (two sparse products), normalised by sum, capped; where nothing is carried over the squared
    difference of both sums. Per sample with a statement edge."""
    x = edges.join(cells.select(sample, F.col("b").alias("src"), F.col("s").alias("i"), F.col("m").alias("ma")), [sample, "src"])
    x = x.join(cells.select(sample, F.col("b").alias("dst"), F.col("s").alias("j"), F.col("m").alias("mb")), [sample, "dst"])
    p = x.groupBy(sample, "i", "j").agg(F.sum(F.col("ma") * F.col("mb")).alias("p"))
    z = p.groupBy(sample).agg(F.sum("p").alias("_z"))
    n = source_edges.groupBy(sample).agg(F.count("*").alias("_n"))
    both = source_edges.join(n, sample).join(p, [sample, "i", "j"], "left").join(z, sample, "left")
    share = F.greatest(F.coalesce(F.col("p") / F.col("_z"), F.lit(0.0)), F.lit(floor))
    kl = F.least(F.sum(F.log(1 / F.col("_n") / share) / F.col("_n")), F.lit(cap))
    out = both.groupBy(sample).agg(kl.alias("_kl"), F.first(F.coalesce("_z", F.lit(0.0))).alias("_z"), F.first("_n").alias("_n"))
    return out.select(sample, F.round(F.when(F.col("_z") < floor, F.pow(F.col("_z") - F.col("_n"), F.lit(2))).otherwise(F.col("_kl")), 6).alias("loss"))


def gap_clusters(df: DataFrame, by: list[str], order: str, gap: float) -> DataFrame:
    """Number clusters of neighbours in a group; a gap over `gap` begins a new one."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def canonical(df: DataFrame, by: list[str], preferred: Column, order: str) -> DataFrame:
    """Of each group the first preferred row, else the first; rows whose group is null all stay."""
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    best = df.where(known).groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct((~preferred).alias("p"), order)).alias("_x")).select("_x.*")
    return best.unionByName(df.where(~known))

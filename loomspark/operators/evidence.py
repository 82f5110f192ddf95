"""Building graphs and alignments out of decoded tables, and checks of their evidence."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def control_flow(instructions: DataFrame, sample: str = "sample") -> tuple[DataFrame, DataFrame]:
    """Blocks (sample, b, start, end) and edges (sample, src, dst, etype) of instructions (sample, addr, size, kind, target).

    kind: jump, branch (conditional), call, ret or other; target null if unknown. Blocks begin at the first instruction, behind jumps, branches and returns,
    and at targets. A block's last instruction says its edges; a target in a block with a number not larger than the source's is a back edge.
    """
    w = Window.partitionBy(sample).orderBy("addr")
    ends = F.col("kind").isin("jump", "branch", "ret")
    targets = instructions.where(F.col("kind").isin("jump", "branch") & F.col("target").isNotNull()).select(sample, F.col("target").alias("addr"), F.lit(True).alias("hit")).distinct()
    x = instructions.join(targets, [sample, "addr"], "left").withColumn("after", F.lag(ends, 1, True).over(w))
    x = x.withColumn("b", F.sum((F.col("after") | F.coalesce("hit", F.lit(False))).cast("int")).over(w) - 1)
    blocks = x.groupBy(sample, "b").agg(F.min("addr").alias("start"), F.max(F.col("addr") + F.col("size")).alias("end"), F.max_by(F.struct("kind", "target"), "addr").alias("last"))
    block_of = x.select(sample, F.col("addr").alias("target"), F.col("b").alias("tb"))
    last = blocks.select(sample, "b", "last.kind", "last.target").join(block_of, [sample, "target"], "left")
    jump = last.where(F.col("kind").isin("jump", "branch") & F.col("tb").isNotNull())
    jumps = jump.select(sample, F.col("b").alias("src"), F.col("tb").alias("dst"), F.when(F.col("tb") <= F.col("b"), 2).when(F.col("kind") == "jump", 1).otherwise(0).alias("etype"))
    following = blocks.select(sample, (F.col("b") - 1).alias("b"), F.col("b").alias("dst"))
    falls = last.where(~F.col("kind").isin("jump", "ret")).join(following, [sample, "b"])
    falls = falls.select(sample, F.col("b").alias("src"), "dst", F.when(F.col("kind") == "branch", 0).when(F.col("kind") == "call", 3).otherwise(1).alias("etype"))
    return blocks.select(sample, "b", "start", "end"), jumps.union(falls)


def probed(blocks: DataFrame, points: DataFrame, on: list[str], step: int = 4) -> DataFrame:
    """The older join of blocks to addresses: equality with every step-th address of [start, end]."""
    return blocks.withColumn("addr", F.explode(F.sequence("start", "end", F.lit(step)))).join(points, [*on, "addr"])


def soft_cells(lines: DataFrame, columns: DataFrame, sample: str = "sample", missing: float = 0.85) -> DataFrame:
    """Alignment cells out of lines (sample, b, line, c) and columns (sample, line, s): mass 1 / number of a block's columns; the confidence (largest of its lines, `missing` for none) is divided alike."""
    hit = lines.join(columns, [sample, "line"]).groupBy(sample, "b", "s").agg(F.max(F.coalesce("c", F.lit(missing))).alias("c"))
    n = hit.groupBy(sample, "b").agg(F.count("*").alias("n"))
    return hit.join(n, [sample, "b"]).select(sample, "b", "s", (1 / F.col("n")).alias("m"), (F.when(F.col("c") > 0, F.col("c")).otherwise(missing) / F.col("n")).alias("w"))


def line_columns(lines: DataFrame, sample: str = "sample") -> DataFrame:
    """Distinct lines of a sample as columns 0, 1, ... in order: the matrix that is rebuilt where none is stored."""
    return lines.select(sample, "line").distinct().withColumn("s", F.dense_rank().over(Window.partitionBy(sample).orderBy("line")) - 1)


def overlap_violations(cells: DataFrame, lines: DataFrame, statements: DataFrame, sample: str = "sample", high: float = 0.7) -> DataFrame:
    """Per sample: blocks whose peak statement holds none of their lines, and cells of mass over 0.01 and high confidence alike. statements: sample, s, start_line, end_line."""
    meets = lines.join(statements, sample).where("line BETWEEN start_line AND end_line").select(sample, "b", "s").distinct().withColumn("ok", F.lit(True))
    some = lines.select(sample, "b").distinct()
    peak = cells.groupBy(sample, "b").agg(F.max_by("s", F.struct("m", (-F.col("s")).alias("k"))).alias("peak"), F.max("m").alias("top")).where("top >= 1e-6").join(some, [sample, "b"])
    bad_peak = peak.join(meets.withColumnRenamed("s", "peak"), [sample, "b", "peak"], "left").groupBy(sample).agg(F.count("*").alias("n_blocks"), F.count_if(F.col("ok").isNull()).alias("bad_peaks"))
    strong = cells.where((F.col("m") > 0.01) & (F.col("w") >= high)).join(some, [sample, "b"]).join(meets, [sample, "b", "s"], "left").groupBy(sample).agg(F.count_if(F.col("ok").isNull()).alias("bad_cells"))
    return bad_peak.join(strong, sample, "left").na.fill(0, ["bad_cells"])


def column_statements(cells: DataFrame, lines: DataFrame, statements: DataFrame, sample: str = "sample", least: float = 0.005) -> DataFrame:
    """Each column's statement: of those that hold lines of blocks with mass in it, no compound if another is there, the one with the most such lines, then the deepest, shortest, first.

    statements: sample, id, compound, depth, start_line, end_line. Columns without support have no row.
    """
    support = cells.where(F.col("m") > least).select(sample, "b", "s").join(lines.select(sample, "b", "line"), [sample, "b"]).select(sample, "s", "line").distinct()
    on_line = statements.withColumn("line", F.explode(F.sequence("start_line", "end_line")))
    hit = support.join(on_line, [sample, "line"]).groupBy(sample, "s", "id", "compound", "depth", (F.col("end_line") - F.col("start_line")).alias("span")).agg(F.count("*").alias("support"))
    best = F.struct((~F.col("compound")).alias("p"), "support", "depth", (-F.col("span")).alias("w"), (-F.col("id")).alias("i"))
    return hit.groupBy(sample, "s").agg(F.max_by(F.struct("id", "support"), best).alias("_x")).select(sample, "s", "_x.id", "_x.support")


def region_mask(cells: DataFrame, regions: DataFrame, sample: str = "sample", least: float = 0.01) -> DataFrame:
    """Region pairs (region, s_region) whose blocks and statements share mass over `least`. regions: sample, side ('b' or 's'), node, region."""
    b = regions.where("side = 'b'").select(sample, F.col("node").alias("b"), "region")
    s = regions.where("side = 's'").select(sample, F.col("node").alias("s"), F.col("region").alias("s_region"))
    return cells.join(b, [sample, "b"]).join(s, [sample, "s"]).groupBy(sample, "region", "s_region").agg(F.sum("m").alias("mass")).where(F.col("mass") > least)


def best_source(df: DataFrame, keys: list[str], real: Column, order: str) -> DataFrame:
    """An index under several key columns: of each key the last real row, else the last proxy. A row stands under all its keys."""
    rows = df.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))
    return rows.groupBy("key").agg(F.max_by(F.struct(*df.columns), F.struct(real, order)).alias("_x")).select("key", "_x.*")


def test_vectors(spark: SparkSession, n: int, seed: str, most: int) -> DataFrame:
    """(case_id, vec): a small product for up to 3 variables, boundary values, then draws from md5(seed, case, place) until `most` different ones are there."""
    # fixed values: boundaries of 64-bit arithmetic and small numbers
    edge = [-9223372036854775807, -17, -3, -2, -1, 0, 1, 2, 3, 17, 9223372036854775807]
    rows = [tuple(c) for c in itertools.product((-2, -1, 0, 1, 2), repeat=n)] if 0 < n <= 3 else []
    rows += [tuple(v if k == i % n else 0 for k in range(n)) for i, v in enumerate(edge)] if n else [()]
    fixed = list(dict.fromkeys(rows))[:most]
    base = spark.createDataFrame([(k, list(v)) for k, v in enumerate(fixed)], "case_id bigint, vec array<bigint>")
    if len(fixed) >= most or not n:
        return base
    place = F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))
    number = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", place, k.cast("string"))), 1, 12), 16, 10).cast("long")
    draw = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.pmod(number(k), F.lit(200_001)) - 100_000)
    more = spark.range(len(fixed), 2 * most).select(F.col("id").alias("case_id"), draw.alias("vec"))
    every = base.union(more).groupBy("vec").agg(F.min("case_id").alias("case_id"))
    return every.orderBy("case_id").limit(most).select("case_id", "vec")


def primary_file(rows: DataFrame, by: list[str], file: str, order: str) -> DataFrame:
    """The most frequent file; of equals the one seen first, then the last by name."""
    per = rows.groupBy(*by, file).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.groupBy(*by).agg(F.max_by(file, F.struct("n", (-F.col("first")).alias("f"), file)).alias(file))


def normal_depths(outline: DataFrame, by: list[str], depth: str) -> DataFrame:
    """Distinct depths of a group as 0, 1, ..."""
    return outline.withColumn("level", F.dense_rank().over(Window.partitionBy(*by).orderBy(depth)) - 1)


def agreement(df: DataFrame, by: list[str], both: str, agree: str, near: str) -> DataFrame:
    """Pooled rates over all rows with both signals; null where there are none."""
    rate = lambda c: F.round(F.sum(c) / F.nullif(F.sum(both), F.lit(0)), 6)
    return df.groupBy(*by).agg(F.sum(both).alias("n_both"), rate(agree).alias("agree"), rate(near).alias("near"))


def counter_means(df: DataFrame, counters: list[str]) -> DataFrame:
    """Means over all samples of their counters; a missing one counts as 0."""
    return df.agg(F.count("*").alias("n_samples"), *[F.round(F.avg(F.coalesce(c, F.lit(0))), 6).alias(c) for c in counters])


def packed_verdicts(df: DataFrame, function: str, passed: Column, tier: Column, floor: int, consent: Column) -> DataFrame:
    """Accepted verdicts by function with their best tier (`floor` at least), and why others fall out, as counts."""
    reason = F.when(~F.coalesce(consent, F.lit(False)), "not_opted_in").when(~F.coalesce(passed, F.lit(False)), "not_passed").when(tier < floor, "below_tier").otherwise("accepted")
    rows = df.withColumn("_r", reason).withColumn("_t", F.greatest(tier, F.lit(floor)))
    count = {r: F.count_if(F.col("_r") == r).alias(r) for r in ("accepted", "not_opted_in", "not_passed", "below_tier")}
    return rows.groupBy(function).agg(*count.values(), F.max(F.when(F.col("_r") == "accepted", F.col("_t"))).alias("best_tier"))


def evidence_split(df: DataFrame, function: str, slot: str, proof: Column, strict: list[str]) -> DataFrame:
    """Distinct slots with strict proofs, and with contract-backed ones alone."""
    per = df.groupBy(function, slot).agg(F.bool_or(proof.isin(strict)).alias("s"))
    return per.agg(F.count_if("s").alias("strict"), F.count_if(~F.col("s")).alias("contract_backed"))


def instance_verdict(score: Column) -> Column:
    return F.when(score >= 0.9, "MATCH").when(score >= 0.5, "PARTIAL").otherwise("MISMATCH")


def structure_grade(consistent: Column, empty: Column, in_order: Column, coverage: Column) -> tuple[Column, Column]:
    """(grade, notes): FAIL where lines and matrix disagree, else WARN for over 0.2 of empty blocks, order under 0.7 or coverage under 0.8, else OK. All that holds is noted.

    A missing value counts as one that is fine, but a missing coverage as 0.
    """
    broken = ~F.coalesce(consistent, F.lit(True))
    warnings = {"empty_blocks": F.coalesce(empty, F.lit(0.0)) > 0.2, "order": F.coalesce(in_order, F.lit(1.0)) < 0.7, "coverage": F.coalesce(coverage, F.lit(0.0)) < 0.8}
    some = F.lit(False)
    for w in warnings.values():
        some = some | w
    notes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in {"lines_without_mass": broken, **warnings}.items()]))
    return F.when(broken, "FAIL").when(some, "WARN").otherwise("OK"), notes


def summed_maps(df: DataFrame, column: str) -> DataFrame:
    """Counters (maps) of all rows added up."""
    return df.select(F.explode(column).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))


def padded(column: str, n: int) -> Column:
    """An array cut or filled with 0 to n places."""
    return F.slice(F.concat(F.coalesce(F.col(column), F.array().cast("array<int>")), F.array_repeat(F.lit(0), n)), 1, n)

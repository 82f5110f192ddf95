"""Joins of the kinds that a plain equality does not express."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled
from .spread import parts, spread


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Points in [low, high) of intervals with the same keys. Both sides are cut into cells of `width`, so the join is on keys and a cell, not on all pairs of a key."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    last = F.greatest(cell(low), F.ceil(F.col(high) / width).cast("long") - 1)
    cells = intervals.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), last)))
    found = points.withColumn("_cell", cell(at)).join(cells, [*on, "_cell"])
    return found.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def prefer_flagged(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """Rows of a group that are flagged, or all of the group where none is."""
    some = df.groupBy(*by).agg(F.bool_or(flag).alias("_some"))
    return df.join(some, by).where(flag | ~F.col("_some")).drop("_some")


def overlap_or_widened(left: DataFrame, right: DataFrame, on: list[str], low: str, high: str, start: str, end: str, slack: float, width: float) -> DataFrame:
    """Overlaps of closed intervals; a left row without any is tried again with both its ends moved out by slack. Adds `widened`.

    One join on the widened range serves both; the exact overlaps of a row win where there are some. Ranges meet in cells of `width`, a pair only in the first cell that
    both have, so a key of very many rows costs what overlaps. Left rows that are equal in all columns count as one row.
    """
    cell = lambda c: F.floor(c / width).cast("long")
    first, last = cell(F.col(low) - slack), cell(F.col(high) + slack)
    a = left.where(F.col(low) <= F.col(high)).withColumn("_a", first).withColumn("_cell", F.explode(F.sequence(first, last)))
    b = right.where(F.col(start) <= F.col(end)).withColumn("_b", cell(F.col(start))).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    rows = a.join(b, [*on, "_cell"]).where(F.col("_cell") == F.greatest("_a", "_b")).drop("_a", "_b", "_cell")
    rows = rows.where((F.col(start) <= F.col(high) + slack) & (F.col(end) >= F.col(low) - slack))
    rows = rows.withColumn("widened", ~((F.col(start) <= F.col(high)) & (F.col(end) >= F.col(low))))
    some = rows.groupBy(*left.columns).agg(F.bool_and("widened").alias("_all"))
    same = F.lit(True)
    for c in left.columns:
        same = same & rows[c].eqNullSafe(some[c])
    return rows.join(some.where("NOT _all"), same, "left_semi").where("NOT widened").unionByName(rows.join(some.where("_all"), same, "left_semi"))


def jaccard_argmax(a: DataFrame, b: DataFrame, a_key: str, b_key: str, item: str, least: float) -> DataFrame:
    """For each a its most similar b by the Jaccard of distinct items, `least` at least (over 0); of equals the smallest b.

    From 0.5 on sets meet by their rare items. Below, the first items that two sets must share are nearly all of a set, so frequent items pair nearly all sets; there all of them are counted, in blocks.
    """
    x, y = (side.select(F.col(key).alias("_k"), item).where(F.col("_k").isNotNull() & F.col(item).isNotNull()).distinct() for side, key in ((a, a_key), (b, b_key)))
    best = (_best_by_prefixes if least >= 0.5 else _best_in_blocks)(x, y, item, least).groupBy("_a").agg(F.max_by(F.struct("_b", "jaccard"), F.struct("jaccard", (-F.col("_b")).alias("k"))).alias("_x"))
    return best.select(F.col("_a").alias(a_key), F.col("_x._b").alias(b_key), F.round("_x.jaccard", 6).alias("jaccard"))


#: Sets of a block of a and items of all of them, and items of a slice of b.
BLOCK_SETS, BLOCK_ITEMS, SLICE_ITEMS = 512, 65_536, 2_000_000


def _best_in_blocks(x: DataFrame, y: DataFrame, item: str, least: float) -> DataFrame:
    """(_a, _b, jaccard): of each a the best b of every slice of b. Blocks of a and slices of b are bounded, each two meet in one group, and the counts of a group are products of 0-1 matrices over a's items."""
    x = settled(x)
    numbers = settled(x.select(item).distinct().withColumn("_i", F.monotonically_increasing_id()))  # numbers stand for the items of a; of others only how many there are matters

    def sets(side: DataFrame) -> DataFrame:
        found = side.join(numbers, item, "left").groupBy("_k").agg(F.count("*").alias("_n"), F.collect_list("_i").alias("_s"))
        return settled(found.where(F.size("_s") > 0))

    xs, ys = sets(x), sets(y)
    n_blocks = max(parts(xs, BLOCK_SETS), parts(xs, BLOCK_ITEMS, F.size("_s")))
    n_slices = parts(ys, SLICE_ITEMS, F.size("_s"))
    part = lambda n: F.pmod(F.xxhash64("_k"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    on = ["_block", "_slice"]
    left = spread(xs.withColumn("_block", part(n_blocks)).withColumn("_slice", every(n_slices)), on, n_blocks * n_slices)
    right = spread(ys.withColumn("_slice", part(n_slices)).withColumn("_block", every(n_blocks)), on, n_blocks * n_slices)
    kinds = dict(xs.dtypes)["_k"], dict(ys.dtypes)["_k"]

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        return _best_of_block(p, q, least)

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, f"_a {kinds[0]}, _b {kinds[1]}, jaccard double")


def _best_of_block(p: pa.Table, q: pa.Table, least: float) -> pa.Table:
    """The best row of q for each row of p, where there is one; rows are _k, _n (size of the set) and _s (those of its items that are numbered)."""
    q = q.sort_by("_k")  # the first of equals is the smallest
    flat = lambda t: (t["_n"].to_numpy().astype("int64"), *(lambda s: (s.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(s)), s.value_lengths().to_numpy(zero_copy_only=False))))(t["_s"].combine_chunks()))
    n, items, of = flat(p)
    m, others, row = flat(q)
    best, at = np.zeros(len(n)), np.full(len(n), -1)
    if len(n) and len(m):
        known, place = np.unique(items, return_inverse=True)
        has = np.zeros((len(known), len(n)), "float32")
        has[place, of] = 1
        column = np.minimum(np.searchsorted(known, others), len(known) - 1)
        row, column = row[known[column] == others], column[known[column] == others]
        step = min(4096, max(1, 4_000_000 // len(known)))
        for low in range(0, len(m), step):
            size = m[low : low + step]
            i, j = np.searchsorted(row, [low, low + step])
            hit = np.zeros((len(size), len(known)), "float32")
            hit[row[i:j] - low, column[i:j]] = 1
            common = (hit @ has).astype("float64")
            score = common / (size[:, None] + n[None, :] - common)
            top = score.argmax(axis=0)
            value = score[top, np.arange(len(n))]
            at, best = np.where(value > best, top + low, at), np.maximum(value, best)
    kept = np.flatnonzero((at >= 0) & (best >= least))
    return pa.table({"_a": p["_k"].take(kept), "_b": q["_k"].take(at[kept]), "jaccard": best[kept]})


def _best_by_prefixes(x: DataFrame, y: DataFrame, item: str, least: float) -> DataFrame:
    """(_a, _b, jaccard) of all pairs of at least that similarity.

    Items are ordered by how many sets have them. Of n items in that order two sets of such a similarity share one of the first n - ceil(least * n) + 1 of both, so
    only these are joined, and the most common items of a set pair nobody; sizes must be within the same ratio. What remains is counted on the whole sets.
    """
    x, y = settled(x), settled(y)
    often = settled(x.unionByName(y).groupBy(item).agg(F.count("*").alias("_f")).withColumn("_i", F.monotonically_increasing_id()))  # numbers stand for items

    def sets(side: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("_f", "_i")))
        return settled(side.join(often, item).groupBy("_k").agg(F.transform(ordered, lambda x: x["_i"]).alias("_s")))

    def prefixes(side: DataFrame, key: str, size: str) -> DataFrame:
        n = F.size("_s")
        return side.select(F.col("_k").alias(key), n.alias(size), F.explode(F.slice("_s", 1, n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1)).alias("_i"))

    xs, ys = sets(x), sets(y)
    pairs = prefixes(xs, "_a", "_na").join(prefixes(ys, "_b", "_nb"), "_i").where((F.col("_na") >= F.col("_nb") * least - 1e-9) & (F.col("_nb") >= F.col("_na") * least - 1e-9)).select("_a", "_b").distinct()
    # the sets of a travel with the pairs, those of b are met where they lie
    both = pairs.join(xs.select(F.col("_k").alias("_a"), "_s"), "_a").join(ys.select(F.col("_k").alias("_b"), F.col("_s").alias("_t")), "_b")
    both = both.select("_a", "_b", F.size("_s").alias("_n"), F.size("_t").alias("_m"), F.size(F.array_intersect("_s", "_t")).alias("_i"))
    return both.select("_a", "_b", (F.col("_i") / (F.col("_n") + F.col("_m") - F.col("_i"))).alias("jaccard")).where(F.col("jaccard") >= least)


def cascade(left: DataFrame, right: DataFrame, keys: list[tuple[str, Column, Column]], left_id: str, right_id: str, compatible: Column | None = None) -> DataFrame:
    """Match each left row by the first of several keys that finds a compatible right row; of several the smallest id. Adds `method`, null without a match.

    Every key is an equality join of its own; a row takes the match of the lowest rank.
    """
    found = None
    for k, (name, a, b) in enumerate(keys):
        x, y = left.withColumn("_key", a).where("_key IS NOT NULL"), right.withColumn("_key", b).where("_key IS NOT NULL")
        hit = x.join(y, "_key")
        hit = (hit.where(compatible) if compatible is not None else hit).select(left_id, right_id, F.lit(k).alias("_rank"), F.lit(name).alias("method"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(left_id).agg(F.min(F.struct("_rank", right_id, "method")).alias("_x")).select(left_id, f"_x.{right_id}", "_x.method")
    return left.join(best, left_id, "left")


def overlay(base: DataFrame, extra: DataFrame, key: str, fields: list[str], keep_filled: bool = False) -> DataFrame:
    """Values of extra replace those of base where they are not empty (with keep_filled: only where base's are). Text counts as empty if it is ''."""
    e = extra.select(key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    out = base.join(e, key, "left")
    for f in fields:
        filled = lambda c: F.nullif(c, F.lit("")) if dict(base.dtypes)[f] == "string" else c  # noqa: B023, E731
        new, old = filled(F.col(f"_e_{f}")), F.col(f)
        out = out.withColumn(f, F.coalesce(filled(old), new, old) if keep_filled else F.coalesce(new, old))
    return out.drop(*[f"_e_{f}" for f in fields])


def first_match(probe: DataFrame, build: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Left join with the first build row of each key."""
    one = build.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_x"))
    return probe.join(one, key, "left").select(*probe.columns, *[F.col(f"_x.{c}").alias(c) for c in columns])


def companion(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """Another row of the same group for every row: the next one in the order of a hash, the first one after the last; itself if it is alone.

    Only neighbours in the order meet, so a group of n rows gives n pairs. The order is cut into slices by the hash's first digits; the last row of a slice takes the
    first one of the next, so no group meets in one task.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.withColumns({"_h": h, "_s": F.substring(h, 1, 3)})
    order = F.struct("_h", key)
    firsts = rows.groupBy(group, "_s").agg(F.min_by(key, order).alias("_own"))
    slices = Window.partitionBy(group).orderBy("_s")  # 4,096 rows at most
    whole = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(group, "_s", F.coalesce(F.lead("_own").over(slices), F.first("_own").over(whole)).alias("_after"))
    out = rows.withColumn("_next", F.lead(key).over(Window.partitionBy(group, "_s").orderBy("_h", key))).join(after, [group, "_s"])
    return out.withColumn("companion", F.coalesce("_next", "_after")).drop("_next", "_after", "_h", "_s")


def coverage(expected: DataFrame, stages: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Which expected keys each stage has, as one row per stage: expected, covered, ratio."""
    out = expected.select(*keys).distinct()
    for name, df in stages.items():
        out = out.join(df.select(*keys).distinct().withColumn(f"_{name}", F.lit(1)), keys, "left")
    pairs = ", ".join(f"'{n}', _{n}" for n in stages)
    rows = out.select(*keys, F.expr(f"stack({len(stages)}, {pairs}) AS (stage, hit)"))
    return rows.groupBy("stage").agg(F.count("*").alias("expected"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.greatest(F.lit(1), F.count("*")), 6).alias("ratio"))


def projected_edges(edges: DataFrame, placed: DataFrame, sample: list[str], order: str) -> DataFrame:
    """Edges (src, dst, etype) carried over by placed (node, to): both ends placed, no loops, of equal edges the first type by order."""
    a, b = placed.select(*sample, F.col("node").alias("src"), F.col("to").alias("_a")), placed.select(*sample, F.col("node").alias("dst"), F.col("to").alias("_b"))
    out = edges.join(a, [*sample, "src"]).join(b, [*sample, "dst"]).where("_a <> _b")
    return out.groupBy(*sample, F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.min_by("etype", order).alias("etype"))


def edge_scores(gold: DataFrame, found: DataFrame, sample: list[str]) -> DataFrame:
    """Precision, recall and F1 of distinct edges (src, dst) per sample; 0 where a side is empty."""
    on = [*sample, "src", "dst"]
    x, y = gold.select(*on).distinct().withColumn("_g", F.lit(1)), found.select(*on).distinct().withColumn("_f", F.lit(1))
    s = x.join(y, on, "full_outer").groupBy(*sample).agg(F.count("_g").alias("_g"), F.count("_f").alias("_f"), F.count_if(F.col("_g").isNotNull() & F.col("_f").isNotNull()).alias("_b"))
    p, r = F.coalesce(F.col("_b") / F.nullif("_f", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("_b") / F.nullif("_g", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return s.select(*sample, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def multiset_f1(a: DataFrame, b: DataFrame, group: list[str], item: str) -> DataFrame:
    """2 * sum of the smaller counts / all counts, per group; both empty: 1."""
    x, y = a.groupBy(*group, item).agg(F.count("*").alias("_x")), b.groupBy(*group, item).agg(F.count("*").alias("_y"))
    s = x.join(y, [*group, item], "full_outer").na.fill(0, ["_x", "_y"]).groupBy(*group).agg(F.sum(F.least("_x", "_y")).alias("_m"), F.sum(F.col("_x") + F.col("_y")).alias("_n"))
    return s.select(*group, F.round(F.coalesce(2 * F.col("_m") / F.nullif("_n", F.lit(0)), F.lit(1.0)), 6).alias("f1"))


def source_text(places: DataFrame, lines: DataFrame, otherwise: str = "") -> DataFrame:
    """places (file, line_no, ...) with `text` of source lines (file, line_no, text); a line that is not there has another text."""
    return places.join(lines.select("file", "line_no", "text"), ["file", "line_no"], "left").withColumn("text", F.coalesce("text", F.lit(otherwise)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items (null: empty); both empty: 1, one empty: 0."""
    x, y = F.coalesce(a, F.array_except(b, b)), F.coalesce(b, F.array_except(a, a))  # an empty array of the other's type
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) < 1) & (F.size(y) < 1), F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def with_repair(before: DataFrame, after: DataFrame, key: str, fields: list[str], version: str) -> DataFrame:
    """after with `repair`: struct(version, n_changed), how many of a row's fields differ from before (null-safe)."""
    old = before.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    changed = F.lit(0)
    for f in fields:
        changed = changed + (~F.col(f).eqNullSafe(F.col(f"_o_{f}"))).cast("int")
    return after.join(old, key, "left").withColumn("repair", F.struct(F.lit(version).alias("version"), changed.alias("n_changed"))).drop(*[f"_o_{f}" for f in fields])

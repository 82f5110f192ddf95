"""Ranking and choosing candidates, confidence tiers, curriculum buckets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tiers in order, and their weights.
TIERS = ["C0", "C1", "C2", "C3", "C4", "C5"]
TIER_WEIGHTS = [0.0, 0.0, 0.2, 0.5, 0.8, 1.0]
# Slot types by bucket.
BUCKETS = {"condition": ["COND"], "block": ["BLOCK", "CASE"], "control_transfer": ["GOTO", "BREAK", "CONTINUE", "EARLY_EXIT", "CLEANUP_EXIT"]}
# Needles in a candidate's name, in the order in which they are tried, and the family.
FAMILIES = [("interval", "sese_interval"), ("switch_fanin", "switch_fanin"), ("switch_chain", "switch_chain"), ("mixed", "mixed_if_policy"), ("then_only", "then_only"), ("else_only", "else_only"), ("recursive", "recursive"), ("shallow", "shallow")]


def family(name: Column) -> Column:
    out = F.lit("other")
    for needle, kind in reversed(FAMILIES):
        out = F.when(F.contains(name, F.lit(needle)), kind).otherwise(out)
    return F.when(name == "full_fallback", "fallback").when(name == "linear_goto", "linear_goto").otherwise(F.coalesce(out, F.lit("other")))


def soft_targets(df: DataFrame, by: list[str], quality: str, valid: str, tau: float) -> DataFrame:
    """Add `prob`: softmax of quality / tau over a group's valid rows (all rows where none is valid), 8 places; 0 outside the pool.

    A group's largest score and its sum are aggregates that are joined back.
    """
    score, ok = F.coalesce(F.col(quality), F.lit(-1e9)) / max(1e-6, tau), F.coalesce(F.col(valid), F.lit(False))
    top = df.groupBy(*by).agg(F.max(F.when(ok, score)).alias("_v"), F.max(score).alias("_a"))
    rows = df.join(top, by).withColumn("_e", F.when(ok | F.col("_v").isNull(), F.exp(F.least(F.lit(60.0), score - F.coalesce("_v", "_a")))))
    total = rows.groupBy(*by).agg(F.sum("_e").alias("_z"))
    return rows.join(total, by).withColumn("prob", F.round(F.coalesce(F.col("_e") / F.col("_z"), F.lit(0.0)), 8)).select(*df.columns, "prob")


def pooled_choice(df: DataFrame, by: list[str], pools: list[Column], score: str, key: str) -> DataFrame:
    """The row of the highest score (ties: smallest key) in the first pool that has rows; pools from strict to loose. Groups without any drop out."""
    tier = F.coalesce(*[F.when(p, k) for k, p in enumerate(pools)])
    order = F.struct((-F.col("_tier")).alias("t"), F.coalesce(score, F.lit(float("-inf"))).alias("s"), (-F.col(key)).alias("k"))
    kept = df.withColumn("_tier", tier).where("_tier IS NOT NULL")
    return kept.groupBy(*by).agg(F.max_by(F.struct(key, score, F.col("_tier").alias("pool")), order).alias("_x")).select(*by, "_x.*")


def best(df: DataFrame, by: list[str], score: Column, key: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(score, -F.col(key))).alias("_x")).select(*by, "_x.*")


def capped(df: DataFrame, by: list[str], order: list[Column], cap: int, slices: int = 64) -> DataFrame:
    """The first `cap` rows of each group, with their `place`: first of each of `slices` parts by a hash of the row, then of what is left of them, so no group meets in one task."""
    hashed = [c for c, t in df.dtypes if "map<" not in t]
    part = Window.partitionBy(*by, "_part").orderBy(*order)
    some = df.withColumn("_part", F.pmod(F.xxhash64(*hashed), F.lit(slices))).withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= cap).drop("_part", "_k")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= cap)


def half_top_half_drawn(df: DataFrame, by: list[str], key: str, order: list[Column], draw: Column, k: int) -> DataFrame:
    """k div 2 rows of the highest rank and the rest of k drawn by hash from the others; key tells the rows of a group apart."""
    head = capped(df, by, order, k // 2).drop("place")
    tail = df.join(head.select(*by, key), [*by, key], "left_anti")
    return head.unionByName(capped(tail, by, [draw, F.col(key)], k - k // 2).drop("place"))


def hits_at(df: DataFrame, by: list[str], order: list[Column], hit: Column, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return capped(df, by, order, max(ks)).groupBy(*by).agg(*[F.bool_or(hit & (F.col("place") <= k)).alias(f"top{k}") for k in ks])


def confidence_tier(external: Column, proposed: Column, gate: Column, v0: Column, v1: Column, v1_clean: Column, v2: Column, v3: Column) -> Column:
    """C0 for what was not generated, not gated, or fails grammar or skeleton; C3 if validated by V3, C2 if V1 is clean and V2 holds, else C1."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(external) | yes(proposed) | no(gate) | no(v0) | no(v1), "C0").when(yes(v3), "C3").when(yes(v1_clean) & yes(v2), "C2").otherwise("C1")


def tier_rank(tier: Column) -> Column:
    """Place of a tier; unknown ones count as C0."""
    return F.greatest(F.array_position(F.array(*map(F.lit, TIERS)), tier) - 1, F.lit(0)).cast("int")


def tier_weight(tier: Column) -> Column:
    return F.get(F.array(*map(F.lit, TIER_WEIGHTS)), tier_rank(tier))


def curriculum_bucket(slot_type: Column, best_rank: Column) -> Column:
    strength = F.when(best_rank >= 3, "strong").when(best_rank >= 2, "weak").otherwise("prior")
    kind = F.lit("other")
    for name, types in BUCKETS.items():
        kind = F.when(slot_type.isin(types), name).otherwise(kind)
    return F.concat_ws("_", strength, kind)


def validator_score(ok: Column, controls: Column, structured: Column, locality: Column, fallback: Column, escapes: dict[str, Column], empty: Column, empty_context: Column, outside: Column, fatal: Column) -> Column:
    """A candidate's validation score; escapes by kind: goto, break, continue, early_exit, cleanup_exit."""
    # fixed values: the weights
    weights = {"goto": 0.2, "break": 0.08, "continue": 0.05, "early_exit": 0.04, "cleanup_exit": 0.03}
    out = F.when(ok, 1000.0).otherwise(0.0) + 20.0 * controls + 0.5 * structured + 8.0 * locality - 2.0 * fallback
    for kind, c in escapes.items():
        out = out - weights[kind] * c
    return out - 12.0 * empty - 30.0 * empty_context - 3.0 * outside - 100.0 * fatal


# Weights of what can be seen in the binary alone, by feature.
BINARY_WEIGHTS = {
    "structured_bb_ratio": 28.0, "edge_semantic_ratio": 8.0, "edge_explicit_ratio": 4.0, "edge_interval_ratio": 3.0, "slot_pointer_acc": 10.0, "condition_slot_grounded_rate": 7.0,
    "branch_provenance_coverage": 4.0, "condition_polarity_available_rate": 1.5, "edge_cleanup_exit_ratio": 1.0, "switch_semantic_ratio": 3.0, "fallback_bb_ratio": -24.0, "fallback_region_count": -2.5,
    "goto_count": -1.25, "break_count": -0.35, "continue_count": -0.25, "early_exit_count": -0.55, "cleanup_exit_count": -0.35,
}


def binary_score(features: dict[str, Column], valid: Column, n_blocks: Column, slots: Column, branch_coverage: Column, family: Column) -> Column:
    """A candidate's score out of binary-side features (missing ones: 0): weighted sum, slots per block, uncovered branches, and terms of switch chains."""
    f = lambda k: F.coalesce(features[k].cast("double"), F.lit(0.0)) if k in features else F.lit(0.0)
    out = F.when(F.coalesce(valid, F.lit(False)), 1000.0).otherwise(0.0)
    for k, w in BINARY_WEIGHTS.items():
        out = out + w * f(k)
    out = out - 0.35 * slots / F.greatest(F.lit(1.0), n_blocks) - 12.0 * F.greatest(F.lit(0.0), 1 - branch_coverage)
    fan = 1.25 + 5.0 * f("switch_semantic_ratio") - 0.75 * f("edge_goto_ratio") - f("fallback_bb_ratio")
    chain = -(0.75 + 1.5 * f("edge_goto_ratio") + f("fallback_bb_ratio"))
    return out + F.when(family == "switch_fanin", fan).when(family == "switch_chain", chain).otherwise(0.0)


# Names of candidates that compaction keeps.
CORE = ["cfg_shallow_mvp", "cfg_recursive_mvp", "cfg_shallow_then_only", "cfg_shallow_else_only", "cfg_recursive_then_only", "cfg_recursive_else_only", "cfg_recursive_sese_interval", "cfg_sese_interval_seq", "linear_goto", "full_fallback"]


def compacted_ids(rows: list[dict], total: int = 0, family_cap: int = 0, signature_cap: int = 0, mixed_cap: int = 0, keep: tuple[str, ...] = ()) -> list:
    """The ids that compaction keeps of rows (id, name, family, signature, score), in order; a cap of 0 is none.

    Core names first; of more than `total` one full_fallback and the linear_gotos are protected, the rest goes by score. What is kept counts towards the caps; then
    the others follow by score as long as their family, their signature and the mixed family have room. A row that one cap skips uses up no other.
    """
    if max(total, family_cap, signature_cap, mixed_cap) <= 0:
        return sorted(r["id"] for r in rows)
    by_score = sorted(rows, key=lambda r: r["score"], reverse=True)
    kept = [r for r in rows if r["name"] in CORE or r["name"] in keep]
    if 0 < total < len(kept):
        safe = [r for r in kept if r["name"] == "full_fallback"][:1]
        safe += [r for r in kept if r["name"] == "linear_goto"][: max(0, total - len(safe))]
        named = {r["id"] for r in safe}
        safe += sorted((r for r in kept if r["id"] not in named), key=lambda r: r["score"], reverse=True)[: max(0, total - len(safe))]
        kept = safe
    used = Counter(x for r in kept for x in (("f", r["family"]), ("s", r["signature"])))
    chosen = {r["id"] for r in kept}
    for r in by_score:
        if 0 < total <= len(chosen):
            break
        slots = [(("f", r["family"]), family_cap), (("s", r["signature"]), signature_cap)]
        if r["family"] == "mixed_if_policy":
            slots.append((("f", "mixed_if_policy"), mixed_cap))
        if r["id"] in chosen or any(0 < cap <= used[x] for x, cap in slots):
            continue
        chosen.add(r["id"])
        used.update(x for x, _ in slots[:2])
    return sorted(chosen)


def compact_pool(df: DataFrame, sample: str, key: str, score: list[str], total: int = 0, family_cap: int = 0, signature_cap: int = 0, mixed_cap: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Greedy compaction of each sample's candidates (key, name, family, signature, and score columns, larger first); adds `original_id` and renumbers `key` from 0.

    The caps interact, so this is a fold over one sample's pool; pools are small (hundreds).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        scores = list(zip(*(pdf[c] for c in score), -pdf[key], strict=True))
        rows = [{"id": i, "name": n, "family": f, "signature": s, "score": z} for i, n, f, s, z in zip(pdf[key], pdf["name"], pdf["family"], pdf["signature"], scores, strict=True)]
        out = pdf[pdf[key].isin(compacted_ids(rows, total, family_cap, signature_cap, mixed_cap, keep))].copy()
        out["original_id"] = out[key]
        out[key] = np.arange(len(out), dtype=np.int64)
        return out

    return df.groupBy(sample).applyInPandas(fold, f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, original_id {dict(df.dtypes)[key]}")


def preference_pairs(df: DataFrame, by: str, key: str, quality: str, trainable: Column, seed: str, most: int = 64) -> DataFrame:
    """(by, better, worse, weight): the best trainable row of a group (ties: smallest key) against every worse one; weight = gap within 0.1 to 2.

    Of more than `most` worse rows the best half of `most` stay and the rest is drawn from the others by hash. Groups of one row or without a trainable one have none.
    """
    best_ = df.where(trainable).groupBy(by).agg(F.max_by(F.struct(F.col(key).alias("better"), F.col(quality).alias("_top")), F.struct(quality, -F.col(key))).alias("_x")).select(by, "_x.*")
    worse = df.join(best_, by).where((F.col(key) != F.col("better")) & (F.col("_top") - F.col(quality) > 1e-6))
    worse = worse.select(by, "better", F.col(key).alias("worse"), F.col(quality).alias("_q"), (F.col("_top") - F.col(quality)).alias("_gap"))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("worse").cast("string")))
    rows = half_top_half_drawn(worse, [by], "worse", [F.desc("_q"), F.col("worse")], drawn, most)
    return rows.select(by, "better", "worse", F.round(F.least(F.greatest(F.col("_gap"), F.lit(0.1)), F.lit(2.0)), 6).alias("weight"))


def learned_score(learned: Column, binary: Column, has_signal: bool = True) -> Column:
    """A learned score with 0.08 of the binary-side one; without any learned weight the binary-side score alone."""
    return learned + 0.08 * binary if has_signal else binary


def fit_pairwise(better: np.ndarray, worse: np.ndarray, weight: np.ndarray, epochs: int = 80, rate: float = 0.05, l2: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights of a linear ranker by stochastic logistic loss over pairs (rows of standardised features); a bounded sample on the driver."""
    rng, w = np.random.default_rng(seed), np.zeros(better.shape[1])
    diff = better - worse
    for _ in range(epochs):
        for k in rng.permutation(len(diff)):
            p = 1 / (1 + np.exp(np.clip(diff[k] @ w, -30, 30)))
            w += rate * (weight[k] * p * diff[k] - l2 * w)
    return w


def scored(df: DataFrame, features: list[str], weights: np.ndarray, name: str = "ranker_score") -> DataFrame:
    """A linear ranker as an expression."""
    out = F.lit(0.0)
    for f, w in zip(features, weights, strict=True):
        out = out + F.col(f) * float(w)
    return df.withColumn(name, F.round(out, 6))


def external_scores(df: DataFrame, scorer, name: str = "score") -> DataFrame:
    """Apply a pluggable scorer (a function of a pandas frame, to a series) batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: np.asarray(scorer(b), float)})

    return df.mapInPandas(run, f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, `{name}` double")

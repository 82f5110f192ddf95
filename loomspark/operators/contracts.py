"""Gates, contracts and audits of candidates and slots: ladders of conditions over joined facts.

Null facts count as false, null numbers as 0, unless a function says otherwise; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of slots.
ESCAPES = ["GOTO", "BREAK", "CONTINUE", "EARLY_EXIT", "CLEANUP_EXIT"]
STRUCTURAL = ["COND", "BLOCK", "CASE"]
UNSUPPORTED = ["UNSTRUCTURED_REGION"]
# What a candidate must satisfy to be handed on, in order.
GATE = [
    "validator_valid", "bb_coverage_ok", "edge_preservation_ok", "strict_edge_preservation_ok", "slot_grounding_ok", "parse_success", "fatal_error_zero", "slot_locality_ready", "empty_control_with_context_zero",
    "body_bb_outside_control_zero", "skeleton_slot_lowerer_success", "contract_consistency_pass",
]


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _n(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _named(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(_yes(c), F.lit(n)) for n, c in conditions.items()]))


def gate(facts: dict[str, Column]) -> Column:
    """struct(passed, failed): failed names what is not satisfied; a fact that is not given is not."""
    failed = _named({k: ~_yes(facts[k]) if k in facts else F.lit(True) for k in GATE})
    return F.struct((F.size(failed) == 0).alias("passed"), failed.alias("failed"))


def slot_policy(passed: Column, slot_type: Column, escape: Column, repair: Column, anchor: Column, escapes: Column, strong: int, weak: int) -> Column:
    """struct(tier, tier_name, alignment, validation, weight, policy, reasons) of a slot before candidates are validated; a ladder.

    What fails the gate, has no anchor or a kind that is not supported or not known is C0; escapes are C1; structural slots are C2 as repairs or in functions of up to
    `strong` escapes, C1 up to `weak`, else C0.
    """
    kind = F.upper(F.coalesce(slot_type, F.lit("")))
    known = kind.isin(*STRUCTURAL, *ESCAPES, *UNSUPPORTED)
    why = _named({"b_gate_failed": ~_yes(passed), "missing_skeleton_anchor": ~_yes(anchor), "unsupported_unstructured_region": kind.isin(*UNSUPPORTED), "unknown_slot_type": ~known})

    def row(tier: str, name: str, alignment: float, validation: float, weight: float, policy: str, reasons: Column) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in (("tier", tier), ("tier_name", name), ("alignment", alignment), ("validation", validation), ("weight", weight), ("policy", policy))], reasons.alias("reasons"))

    one = lambda x: F.array(F.lit(x))
    return (
        F.when(F.size(why) > 0, row("C0", "invalid_or_unmatched", 0.0, 0.0, 0.0, "skip", why))
        .when(_yes(escape), row("C1", "binary_only_or_template_prior", 0.25, 0.0, 0.0, "binary_template_prior_only", one("escape_or_control_transfer_slot")))
        .when(kind.isin(*STRUCTURAL) & _yes(repair), row("C2", "cfg_liveout_compatible_weak", 0.45, 0.2, 0.2, "weak_supervision_after_candidate_validation", one("module_b_repair_slot_requires_extra_validation")))
        .when(kind.isin(*STRUCTURAL) & (_n(escapes) <= strong), row("C2", "contract_ready_needs_candidate_validator", 0.6, 0.2, 0.2, "eligible_for_scts_candidates_not_hard_label_yet", one("contract_ready_but_no_slot_label_candidate_validated")))
        .when(kind.isin(*STRUCTURAL) & (_n(escapes) <= weak), row("C1", "heuristic_prior_escape_moderate", 0.35, 0.0, 0.0, "candidate_prior_only_until_validator_passes", one("moderate_function_escape_count")))
        .otherwise(row("C0", "too_ambiguous_for_o0", 0.0, 0.0, 0.0, "skip", one("escape_heavy_function_requires_later_global_validation")))
    )


def spot_check(samples: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """Add `grade` (PASS, WARN or FAIL) and `notes` to core records. facts: consistent (lines and matrix agree), coverage, mean_conf."""
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda s, x: s + x)
    none = lambda c: size(c) < 1
    n_bb, n_s, m = size("bin_block_lengths"), size("src_stmt_lengths"), F.col("alignment_matrix")
    blocks, statements, matrix = n_bb > 0, n_s > 0, (size("alignment_matrix") > 0) & (F.coalesce(F.size(m[0]), F.lit(0)) > 0)
    wide = F.size(m[0])
    broken = {f"empty: {c}": none(c) for c in ("bin_opcodes", "bin_operand_types", "bin_operand_values", "bin_block_lengths")}
    broken["bin_edge_index is no pair of lists"] = size("bin_edge_index") != 2
    broken["empty: bin_struct_features"] = none("bin_struct_features")
    rows = ~none("bin_struct_features") & blocks & (size("bin_struct_features") != n_bb)
    broken["features do not match blocks"] = rows
    broken["features are not 12"] = ~none("bin_struct_features") & blocks & ~rows & (F.size(F.col("bin_struct_features")[0]) != 12)
    broken["block lengths do not sum to instructions"] = blocks & ~none("bin_opcodes") & (total("bin_block_lengths") != size("bin_opcodes"))
    broken["empty: src_token_ids"], broken["empty: src_stmt_lengths"] = none("src_token_ids"), none("src_stmt_lengths")
    broken["statement lengths do not sum to tokens"] = statements & ~none("src_token_ids") & (total("src_stmt_lengths") != size("src_token_ids"))
    broken["missing: src_ast_types"] = size("src_ast_types") < 0
    broken["types do not match statements"] = statements & (size("src_ast_types") >= 0) & (size("src_ast_types") != n_s)
    broken["missing: block_src_lines"] = size("block_src_lines") < 0
    broken["lines do not match blocks"] = blocks & (size("block_src_lines") >= 0) & (size("block_src_lines") != n_bb)
    broken["alignment_matrix is empty"] = size("alignment_matrix") < 1
    broken["alignment_matrix has no columns"] = (size("alignment_matrix") > 0) & ~matrix
    broken["alignment rows do not match blocks"] = matrix & blocks & (size("alignment_matrix") != n_bb)
    broken["alignment columns do not match statements"] = matrix & statements & (wide != n_s)
    broken["confidence is shaped unlike the matrix"] = (size("alignment_confidence") >= 0) & (size("alignment_matrix") > 0) & ((size("alignment_confidence") != size("alignment_matrix")) | (F.size(F.col("alignment_confidence")[0]) != wide))
    broken["missing: pattern_labels"] = size("pattern_labels") < 0
    broken["labels do not match blocks"] = blocks & (size("pattern_labels") >= 0) & (size("pattern_labels") != n_bb)
    broken["lines without mass"] = ~F.coalesce(facts["consistent"], F.lit(True))
    odd = {
        "no edges": (size("bin_edge_index") == 2) & (F.size(F.col("bin_edge_index")[0]) == 0),
        "no statement edges": (size("src_edge_index") == 2) & (F.size(F.col("src_edge_index")[0]) == 0),
        "matrix is zero": matrix & ~F.exists(m, lambda r: F.exists(r, lambda x: F.abs(x) > 1e-12)),
        "no block is covered": _n(facts["coverage"]) <= 0,
        "covered without confidence": (_n(facts["mean_conf"]) <= 0) & (_n(facts["coverage"]) > 0),
    }
    bad, warn = _named(broken), _named(odd)
    grade = F.when(F.size(bad) > 0, "FAIL").when(F.size(warn) > 0, "WARN").otherwise("PASS")
    return samples.withColumns({"grade": grade, "notes": F.when(F.size(bad) > 0, bad).otherwise(warn)})


def instance_checks(instructions: DataFrame, statements: DataFrame, by: list[str]) -> DataFrame:
    """Verdict of each block (by): what its instructions (by, place, mnemonic, call_target, immediates) call, return and compare with against its statement (by, type, text).

    A call counts if the text calls that name or one that holds it or is in it; a last `ret` if the text returns, is a compound or ends a block; an immediate other than 0 if its decimal or
    hexadecimal digits, its character in quotes, or for 1 a truth stand there, else half. MATCH from 0.9, PARTIAL from 0.5, else MISMATCH; SKIP without checks, NODATA without text or code.
    """
    text = F.coalesce("text", F.lit(""))
    calls = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))
    x = instructions.join(statements.select(*by, "type", "text"), by, "left").where(F.trim(text) != "").withColumns({"_t": text, "_calls": calls})
    target = F.trim(F.replace("call_target", F.lit("@plt"), F.lit("")))
    base = F.element_at(F.split(target, r"\."), -1)
    called = x.where(F.col("call_target").isNotNull() & ~F.startswith(target, F.lit("0x"))).withColumns({"_a": target, "_b": base})
    hit = F.exists("_calls", lambda c: (c == F.col("_a")) | F.contains(c, F.col("_b")) | F.contains(F.col("_b"), c))
    call = called.select(*by, hit.cast("double").alias("score"))
    last = x.groupBy(*by).agg(F.max_by(F.struct("mnemonic", "type", "_t"), "place").alias("z")).where("z.mnemonic = 'ret'")
    ret = last.select(*by, (F.contains("z._t", F.lit("return")) | _yes(F.col("z.type").isin("return_statement", "compound_statement")) | F.contains("z._t", F.lit("}"))).cast("double").alias("score"))
    values = x.where(F.col("mnemonic").isin("cmp", "test")).select(*by, "_t", F.explode("immediates").alias("v")).where("v <> 0")
    v, t = F.col("v"), F.col("_t")
    hexed = F.concat(F.when(v < 0, "-0x").otherwise("0x"), F.lower(F.hex(F.abs(v))))
    char = F.when((v >= 32) & (v < 127), F.chr(v))
    quoted = F.coalesce(F.contains(t, F.concat(F.lit("'"), char, F.lit("'"))) | F.contains(t, F.concat(F.lit('"'), char, F.lit('"'))), F.lit(False))
    truth = (v == 1) & (F.contains(t, F.lit("true")) | F.contains(t, F.lit("TRUE")) | F.contains(t, F.lit("!=")))
    immediate = values.select(*by, F.when(F.contains(t, v.cast("string")) | F.contains(t, hexed) | quoted | truth, 1.0).otherwise(0.5).alias("score"))
    scores = call.unionByName(ret).unionByName(immediate).groupBy(*by).agg(F.count("*").alias("checks"), F.avg("score").alias("score"))
    some = x.select(*by).distinct().withColumn("_some", F.lit(True))
    out = instructions.select(*by).distinct().join(some, by, "left").join(scores, by, "left")
    verdict = F.when(F.col("_some").isNull(), "NODATA").when(F.col("checks").isNull(), "SKIP").when(F.col("score") >= 0.9, "MATCH").when(F.col("score") >= 0.5, "PARTIAL").otherwise("MISMATCH")
    return out.select(*by, verdict.alias("verdict"), F.coalesce("checks", F.lit(0)).alias("checks"), F.round("score", 6).alias("score"))


def candidate_facts(slots: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """What validation asks of candidates (by, n_bb) from their slots (by, slot_id, slot_type, primary, context).

    Adds invalid_refs, missing_blocks, duplicate_blocks (blocks that several slots own; escapes own none), grounded, counts of each escape and `fatal`, the names of what is fatal.
    """
    escape = F.col("slot_type").isin(*ESCAPES)
    s = slots.join(candidates.select(*by, "n_bb"), by)
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    loose = (empty("primary") | empty("context")) & ~escape & ~((F.col("n_bb") == 0) & (F.col("slot_type") == "UNSTRUCTURED_REGION"))
    outside = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<bigint>")), lambda b: (b < 0) | (b >= F.col("n_bb"))))
    per = s.groupBy(*by).agg(
        F.sum(outside(F.col("primary")) + outside(F.col("context"))).cast("long").alias("invalid_refs"),
        F.bool_or(loose).alias("_loose"),
        *[F.count_if(F.col("slot_type") == e).alias(f"n_{e.lower()}") for e in ESCAPES],
    )
    owned = s.where(~escape).select(*by, "n_bb", F.explode("primary").alias("bb")).groupBy(*by, "n_bb", "bb").agg(F.count("*").alias("n"))
    covered = owned.groupBy(*by).agg(F.count_if((F.col("bb") >= 0) & (F.col("bb") < F.col("n_bb"))).alias("_covered"), F.count_if(F.col("n") > 1).alias("duplicate_blocks"))
    out = candidates.join(per, by, "left").join(covered, by, "left").na.fill(0, ["invalid_refs", "_covered", "duplicate_blocks", *[f"n_{e.lower()}" for e in ESCAPES]])
    out = out.withColumns({"missing_blocks": F.col("n_bb") - F.col("_covered"), "grounded": ~_yes(F.col("_loose")) & (F.col("invalid_refs") == 0)})
    fatal = _named({"invalid_bb_ref": F.col("invalid_refs") > 0, "missing_bb_coverage": F.col("missing_blocks") > 0, "duplicate_primary_bb": F.col("duplicate_blocks") > 0, "slot_grounding_incomplete": ~F.col("grounded")})
    return out.withColumn("fatal", fatal).drop("_loose", "_covered")


def label_diagnosis(blocks: DataFrame, edges: DataFrame, sources: DataFrame, sample: str = "sample") -> DataFrame:
    """Per sample how plausible its roles are. blocks: sample, b, role, loop_line, switch_line (its text has a loop; a switch or case), structural (a loop header by structure).

    Loop headers are expected at targets of back edges and structural headers. sources: sample, n_loops, n_switches of the source. Adds the numbers of headers, of false, missed and
    unsupported ones, and how many there are more than in the source.
    """
    targets = edges.where("etype = 2").select(sample, F.col("dst").alias("b")).distinct().withColumn("_target", F.lit(True))
    x = blocks.join(targets, [sample, "b"], "left")
    expected, head, switch = _yes(F.col("_target")) | _yes(F.col("structural")), F.col("role") == 4, F.col("role") == 7
    per = x.groupBy(sample).agg(
        F.count_if(head).alias("loop_headers"),
        F.count_if(head & ~expected).alias("false_loop_headers"),
        F.count_if(~head & expected).alias("missed_loop_headers"),
        F.count_if(head & ~expected & ~_yes(F.col("loop_line"))).alias("unsupported_loop_headers"),
        F.count_if(switch).alias("switch_headers"),
        F.count_if(switch & ~_yes(F.col("switch_line"))).alias("unsupported_switch_headers"),
    )
    out = per.join(sources, sample, "left").na.fill(0, ["n_loops", "n_switches"])
    over = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col(b)).cast("long")
    return out.select(*per.columns, over("loop_headers", "n_loops").alias("loops_over_source"), over("switch_headers", "n_switches").alias("switches_over_source"))


def readiness(s: dict[str, Column]) -> Column:
    """struct(label, reasons) of a report's sums and means (see the names below); n functions, switch_n and large_n of them with switches and large ones, none of them being ready at rate 1."""
    n = F.greatest(s["n"], F.lit(1))
    rate = lambda k: s[k] / n
    part = lambda k, of: F.when(s[of] > 0, s[k] / s[of]).otherwise(1.0)
    hard, clean = s["hard_contract_pass"] == n, s["false_verified"] == 0
    ssa, ground, cover = rate("real_ssa"), s["condition_slot_grounded_rate"], s["branch_provenance_coverage"]
    safe, pool, ready, fallback = rate("safe"), rate("any_safe"), rate("ready"), rate("fallback_functions")
    switch, large = part("switch_ready", "switch_n"), part("large_ready", "large_n")
    why = _named({
        "hard_contract": ~hard, "false_verified": ~clean, "ssa_coverage": ssa < 0.95, "condition_grounding": (ground < 0.9) | (cover < 0.9),
        "safe_selected": safe < 0.5, "safe_pool": pool < 0.5, "decompile_ready": ready < 0.6, "fallback_regions": fallback > 0.1,
        "gotos": s["goto_mean"] > 1, "structured_coverage": s["structured_coverage"] < 0.8, "switches": (s["switch_n"] > 0) & (switch < 0.5),
        "large_functions": (s["large_n"] > 0) & (large < 0.5),
    })
    base = hard & clean & (ssa >= 0.95) & (ground >= 0.9) & (cover >= 0.9)
    full = (safe >= 0.7) & (pool >= 0.8) & (ready >= 0.7) & (fallback <= 0.1) & (s["goto_mean"] <= 1) & (s["structured_coverage"] >= 0.8) & (switch >= 0.5) & (large >= 0.5)
    # fixed values: the labels
    label = F.when(~base, "B_NOT_READY").when(full, "B_READY_FOR_FULL_CD").when((pool >= 0.15) & (ready >= 0.4), "B_READY_FOR_LIMITED_CD").otherwise("B_SAFE_ONLY")
    return F.struct(label.alias("label"), why.alias("reasons"))


def token_file_audit(rows: DataFrame, by: str, source: Column, ids: str, vocabulary: int) -> DataFrame:
    """Per file how many rows have a source of each bucket (readable, weak_fallback, no_src, unresolvable, empty_file, all else), valid ids (some, all within the vocabulary), and both."""
    # fixed values: the buckets of sources
    named = ["readable", "weak_fallback", "no_src", "unresolvable", "empty_file"]
    ok = _yes((F.size(ids) > 0) & F.forall(ids, lambda x: F.coalesce((x >= 0) & (x < vocabulary), F.lit(False))))
    bucket = F.coalesce(source, F.lit("other"))
    x = rows.select(F.col(by), bucket.alias("_s"), ok.alias("_ok"))
    counts = [F.count_if(F.col("_s") == s).alias(f"src_{s}") for s in named]
    return x.groupBy(by).agg(F.count("*").alias("n"), *counts, F.count_if(~F.col("_s").isin(named)).alias("src_other"), F.count_if("_ok").alias("ids_ok"), F.count_if(~F.col("_ok")).alias("ids_bad"), F.count_if(F.col("_ok") & (F.col("_s") == "readable")).alias("both_ok"))


# Weights of rates, of facts that hold, and of counts in a valid candidate's quality.
QUALITY_RATES = {
    "structured_bb_ratio": 28.0, "structured_control_ratio": 6.0, "edge_semantic_ratio": 8.0, "edge_explicit_ratio": 3.0, "edge_interval_ratio": 4.0, "edge_linear_ratio": 1.5, "slot_pointer_acc": 10.0,
    "branch_header_cond_slot_coverage": 8.0, "cond_pointer_acc": 5.0, "block_pointer_acc": 3.0, "goto_pointer_acc": 1.0, "condition_slot_grounded_rate": 7.0, "branch_provenance_coverage": 4.0, "condition_branch_metadata_rate": 3.0,
    "condition_ssa_available_rate": 2.0, "real_condition_ssa_available_rate": 2.0, "if_cond_grounded_rate": 1.0, "loop_cond_grounded_rate": 1.0, "switch_cond_grounded_rate": 1.0, "condition_polarity_available_rate": 1.5,
    "slot_locality_score": 8.0, "edge_goto_ratio": -5.0, "edge_break_ratio": -1.2, "edge_continue_ratio": -0.8, "edge_early_exit_ratio": -1.0, "edge_fallback_ratio": -3.0, "edge_uncovered_ratio": -20.0, "branch_header_cond_slot_gap": -12.0,
}
QUALITY_FACTS = {"strict_edge_preservation_ok": 2.0, "edge_preservation_ok": 1.0, "parse_success": 0.5, "slot_grounding_ok": 0.5}
QUALITY_COUNTS = {
    "fallback_region_count": -2.5, "goto_count": -1.8, "break_count": -0.35, "continue_count": -0.20, "early_exit_count": -0.45, "cleanup_exit_count": -0.35, "empty_control_with_context_count": -20.0, "empty_control_count": -4.0,
    "body_bb_outside_control_count": -3.0,
}


def quality_components(facts: dict[str, Column], n_blocks: Column, hard_valid: Column) -> Column:
    """struct(rank_quality, fallback_ratio, escape_count, cost_feasible, grounding_ready, structured_ready, locality_ready, doc_ready) out of a candidate's facts by name.

    A fact that is not given or null counts as 0 or false; coverage of branch headers and slot locality as 1, the coverage's gap as what it lacks, the structured ratio as structured blocks over
    blocks, the escapes as the sum of their kinds. A strict edge preservation is one. What is not valid stays far below all that is.
    """
    given = lambda k: facts[k].cast("double") if k in facts else F.lit(None).cast("double")
    n = F.greatest(F.lit(1.0), _n(n_blocks))
    v = {k: _n(given(k)) for k in (*QUALITY_RATES, *QUALITY_COUNTS, "fallback_bb_count", "slot_count")}
    v["slot_locality_score"], v["branch_header_cond_slot_coverage"] = (F.coalesce(given(k), F.lit(1.0)) for k in ("slot_locality_score", "branch_header_cond_slot_coverage"))
    v["branch_header_cond_slot_gap"] = F.coalesce(given("branch_header_cond_slot_gap"), F.greatest(F.lit(0.0), 1 - v["branch_header_cond_slot_coverage"]))
    v["structured_bb_ratio"] = F.coalesce(given("structured_bb_ratio"), _n(given("structured_bb_count")) / n)
    kinds = v["goto_count"] + v["break_count"] + v["continue_count"] + v["early_exit_count"] + v["cleanup_exit_count"]
    escapes = F.coalesce(F.nullif(given("escape_count"), F.lit(0.0)), kinds)
    holds = {k: _yes(facts[k]) if k in facts else F.lit(False) for k in (*QUALITY_FACTS, "valid", "bb_coverage_ok")}
    holds["edge_preservation_ok"] = holds["edge_preservation_ok"] | holds["strict_edge_preservation_ok"]
    fallback = v["fallback_bb_count"] / n
    ok = _yes(hard_valid)
    good = F.lit(1000.0) - 24.0 * fallback - 0.35 * v["slot_count"] / n
    for k, w in (QUALITY_RATES | QUALITY_COUNTS).items():
        good = good + w * v[k]
    for k, w in QUALITY_FACTS.items():
        good = good + w * holds[k].cast("double")
    bad = F.lit(-1000.0) - 20.0 * v["edge_uncovered_ratio"] - 5.0 * fallback
    for k in ("valid", "bb_coverage_ok", "edge_preservation_ok"):
        bad = bad + 0.5 * holds[k].cast("double")
    few = (v["goto_count"] <= 2) & (escapes <= 4)
    grounded = (v["slot_pointer_acc"] >= 0.98) & (v["branch_header_cond_slot_coverage"] >= 0.9) & (v["branch_provenance_coverage"] >= 0.9) & (v["condition_slot_grounded_rate"] >= 0.9)
    structured = (v["structured_bb_ratio"] >= 0.6) & (fallback <= 0.3)
    local = (v["slot_locality_score"] >= 0.98) & (v["empty_control_with_context_count"] == 0) & (v["body_bb_outside_control_count"] == 0)
    return F.struct(
        F.round(F.when(ok, good).otherwise(bad), 6).alias("rank_quality"), F.round(fallback, 6).alias("fallback_ratio"), escapes.cast("long").alias("escape_count"), (ok & (fallback <= 0.3) & few).alias("cost_feasible"),
        grounded.alias("grounding_ready"), structured.alias("structured_ready"), local.alias("locality_ready"), (ok & structured & grounded & local & few).alias("doc_ready"),
    )


def structural_target(hard_valid: Column, doc_ready: Column, feasible: Column, outline: Column, kinds: Column, gap: Column, fallback: Column, gotos: Column, escapes: Column, cfg: dict[str, Column] | None = None) -> Column:
    """struct(score, ast_score, tier, status, trainable, confidence, exact, soft): how much a valid candidate's control structure is like the source's.

    cfg: available, score, recall and f1 of the source graph's edges, where known.
    """
    gap = F.abs(_n(gap))
    exact_outline, exact_kinds = (outline >= 0.999) & (gap == 0), kinds >= 0.999
    # fixed values: the weights
    ast = 0.46 * outline + 0.34 * kinds + 0.14 * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), gap / 3)) + 0.04 * exact_outline.cast("double") + 0.02 * exact_kinds.cast("double")
    there = _yes(cfg["available"]) if cfg else F.lit(False)
    g = {k: _n(cfg[k]) if cfg else F.lit(0.0) for k in ("score", "recall", "f1")}
    score = F.when(there, 0.54 * ast + 0.22 * g["score"] + 0.14 * g["recall"] + 0.10 * g["f1"]).otherwise(ast)
    score = score - 0.10 * F.least(F.lit(1.0), _n(fallback)) - 0.03 * F.least(F.lit(1.0), _n(gotos) / 3) - 0.02 * F.least(F.lit(1.0), _n(escapes) / 5)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    doc = _yes(doc_ready)
    soft = _yes(hard_valid) & doc & F.when(there, (g["score"] >= 0.68) & (g["recall"] >= 0.75)).otherwise((outline >= 0.8) & (kinds >= 0.8) & (gap <= 1))
    high = doc & (score >= 0.74) & ((outline >= 0.78) | (kinds >= 0.86) | exact_outline | exact_kinds) & (_n(fallback) <= 0.2)
    medium = doc & (soft | ((score >= 0.62) & ((outline >= 0.64) | (kinds >= 0.74)) & (_n(fallback) <= 0.3)))
    ladder = [
        (~_yes(hard_valid), 0, "invalid_not_trainable"), (high, 6, "high_confidence_structural_source_like"), (medium, 5, "medium_confidence_structural_source_like"), (soft, 4, "low_margin_structural_source_like"),
        (doc, 3, "binary_doc_quality_only"), (_yes(feasible), 2, "binary_cost_feasible_only"), (F.lit(True), 1, "strict_valid_low_confidence"),
    ]
    tier, status = F.lit(None).cast("int"), F.lit(None).cast("string")
    for when, t, s in reversed(ladder):
        tier, status = F.when(when, t).otherwise(tier), F.when(when, s).otherwise(status)
    ok = _yes(hard_valid)
    return F.struct(
        F.when(ok, F.round(score, 6)).otherwise(0.0).alias("score"), F.when(ok, F.round(ast, 6)).otherwise(0.0).alias("ast_score"), tier.alias("tier"), status.alias("status"), (tier >= 5).alias("trainable"),
        F.when(tier >= 6, "high").when(tier >= 5, "medium").when(tier < 4, "low").otherwise("low_margin").alias("confidence"), (ok & (exact_outline | exact_kinds)).alias("exact"), (ok & (soft | medium | high)).alias("soft"),
    )


def rank_quality(target: Column, base: Column, outline: Column, kinds: Column, cfg: dict[str, Column] | None = None) -> Column:
    """10,000 a tier and a preference within it for valid candidates (tier over 0), else the base quality; 6 places."""
    g = {k: _n(cfg[k]) if cfg else F.lit(0.0) for k in ("score", "recall", "f1", "fallback", "escape")}
    # fixed values: the weights
    preference = base + 44 * target["score"] + 18 * target["ast_score"] + 10 * outline + 8 * kinds + 4 * target["exact"].cast("double") + 4 * g["score"] + 3 * g["recall"] + 2 * g["f1"] - 6 * g["fallback"] - 4 * g["escape"]
    return F.round(F.when(target["tier"] > 0, 10000.0 * target["tier"] + preference).otherwise(base), 6)


def audit_tasks(candidates: DataFrame, keys: list[str], text: str, rank: list[Column], slices: int = 64, whole: int = 10_000) -> DataFrame:
    """A review task for each candidate: a stable id of its keys and text, its rank within its slot (the keys but for the last), and what a reviewer fills in.

    Slots of up to `whole` candidates are ranked as they are. If there are larger ones, slots are ranked in parts: candidates of a larger one are dealt to `slices` ranges of the first rank column (of a slot
    whose candidates agree in it, all but one are empty), ranked within their range, and the sizes of the ranges before are added.
    """
    slot = keys[:-1]
    large = candidates.groupBy(*slot).agg(F.count("*").alias("_n")).where(F.col("_n") > whole).select(*slot)
    if large.isEmpty():
        out = candidates.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(*slot).orderBy(*rank)).cast("long"))
    else:
        out = _ranked_in_parts(candidates, large, slot, rank, slices)
    stable = F.concat(F.lit("task_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.coalesce(text, F.lit(""))), 256), 1, 16))
    return out.withColumns({"task_id": stable, "target_text": F.col(text), "passed": F.lit(False), "verdict": F.lit("unreviewed"), "confidence_level": F.lit("C3"), "hard_ce_allowed": F.lit(False)})


def _ranked_in_parts(candidates: DataFrame, large: DataFrame, slot: list[str], rank: list[Column], slices: int) -> DataFrame:
    first = rank[0]
    bounds = candidates.join(large, slot, "left_semi").groupBy(*slot).agg(F.percentile_approx(first, [k / slices for k in range(1, slices)], 1000).alias("_bounds"))
    # bounds are values of the column itself, so a range is how many of them lie below; a slot without bounds is one range
    below = F.coalesce(F.size(F.filter("_bounds", lambda x: x < F.col("_first"))), F.lit(-1))
    dealt = candidates.withColumn("_first", first).join(bounds, slot, "left").withColumn("_range", below).drop("_bounds")
    sizes = dealt.groupBy(*slot, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*slot).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*slot, "_range").orderBy(*rank))
    return dealt.withColumn("_own", own).join(sizes, [*slot, "_range"]).withColumn("candidate_rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_first", "_range")


# A placeholder in a skeleton, its kind, slot and closing semicolon.
PLACEHOLDER = r"<([A-Z_]+):(slot_\d+)>(\s*;)?"


def filled(text: Column, tag: Column, trailing: Column) -> Column:
    """A fill as a statement: closed by a semicolon unless it ends a block; conditions stay as they are."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    closed = F.when((t != "") & ~F.rlike(t, F.lit(r"(;|\}|\*/)$")), F.concat(t, F.lit(";"))).otherwise(t)
    closed = F.when(F.endswith(closed, F.lit("*/")), F.concat(closed, F.lit(";"))).otherwise(closed)
    return F.when(tag == "FILL_COND", t).otherwise(closed)


def rendered(skeletons: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """Skeletons (by, skeleton) with each placeholder replaced by the best candidate of its slot (by, slot_id, candidate_id, rank, weight, text): `rendered`, `ok`, `n_missing`.

    The best has the highest rank, then weight, then id; candidates of white space alone do not count. A placeholder without one stays and is missing; so is a slot of empty candidates.
    """
    best = candidates.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(by, "slot_id").agg(F.max_by("text", F.struct(F.coalesce("rank", F.lit(0)).alias("r"), F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("candidate_id", F.lit("")).alias("i"))).alias("text"))
    hollow = candidates.select(by, "slot_id").distinct().join(best.select(by, "slot_id"), [by, "slot_id"], "left_anti").groupBy(by).agg(F.count("*").alias("_hollow"))
    whole = PLACEHOLDER.replace("(", "(?:")
    parts = skeletons.select(by, F.posexplode(F.split("skeleton", whole)).alias("k", "part"))
    marks = skeletons.select(by, F.posexplode(F.regexp_extract_all("skeleton", F.lit(whole), F.lit(0))).alias("k", "mark"))
    group = lambda g: F.regexp_extract("mark", PLACEHOLDER, g)
    marks = marks.select(by, "k", "mark", group(1).alias("tag"), group(2).alias("slot_id"), group(3).alias("end")).join(best, [by, "slot_id"], "left")
    marks = marks.select(by, "k", F.coalesce(F.when(F.col("text").isNotNull(), filled(F.col("text"), F.col("tag"), F.col("end"))), F.col("mark")).alias("fill"), F.col("text").isNull().cast("int").alias("miss"))
    rows = parts.join(marks, [by, "k"], "left").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", F.concat("part", F.coalesce("fill", F.lit(""))).alias("x")))).alias("t"), F.sum(F.coalesce("miss", F.lit(0))).alias("n_missing"))
    out = rows.join(hollow, by, "left").withColumn("n_missing", F.col("n_missing") + F.coalesce("_hollow", F.lit(0)))
    text = F.array_join(F.transform("t", lambda x: x["x"]), "")
    has = skeletons.select(by, (F.coalesce("skeleton", F.lit("")) != "").alias("_has"))
    return has.join(out, by, "left").select(by, F.when(F.col("_has"), text).alias("rendered"), (F.col("_has") & (F.coalesce("n_missing", F.lit(0)) == 0)).alias("ok"), F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"))


#: Slots of a function that is matched as one row; those of larger ones meet in joins.
WHOLE = 256


def _blocks(c: str) -> Column:
    return F.array_compact(F.array_distinct(F.coalesce(c, F.array()).cast("array<bigint>"))).alias(c)


def slot_scores(slots: DataFrame, by: str) -> DataFrame:
    """(by, p, w, score) of predicted and wanted slots of one kind that have a block in common, or both none: the Jaccard index of their primary blocks, or half of that of their contexts if that is
    more; of slots without primary blocks that of their contexts alone."""
    one = slots.select(by, "side", "sid", "kind", _blocks("primary"), _blocks("context"))
    found = []
    for c in ("primary", "context"):
        # a slot without blocks has one that no other has, so that two of them are alike
        rows = one.select(by, "side", "sid", "kind", F.size(c).alias("n"), F.explode(F.when(F.size(c) == 0, F.array(F.lit(None).cast("bigint"))).otherwise(F.col(c))).alias("block"))
        side = lambda x, name, n: rows.where(F.col("side") == x).select(by, "kind", F.col("sid").alias(name), F.col("n").alias(n), F.coalesce("block", F.lit(0)).alias("block"), F.col("block").isNull().alias("none"))  # noqa: B023, E731
        common = side("p", "p", "n_p").join(side("w", "w", "n_w"), [by, "kind", "block", "none"]).groupBy(by, "p", "w", "n_p", "n_w").agg(F.count("*").alias("n"))
        both = F.when(F.col("n_p") + F.col("n_w") == 0, 1.0).otherwise(F.col("n") / (F.col("n_p") + F.col("n_w") - F.col("n")))
        found.append(common.select(by, "p", "w", both.alias(c), ((F.col("n_p") + F.col("n_w")) == 0).alias(f"no_{c}")))
    sizes = lambda x, name: one.where(F.col("side") == x).select(by, F.col("sid").alias(name), (F.size("primary") > 0).alias(f"has_{name}"))
    pairs = found[0].join(found[1], [by, "p", "w"], "full").join(sizes("p", "p"), [by, "p"]).join(sizes("w", "w"), [by, "w"])
    near = F.coalesce("context", F.lit(0.0))
    return pairs.select(by, "p", "w", F.when(F.col("has_p") | F.col("has_w"), F.greatest(F.coalesce("primary", F.lit(0.0)), 0.5 * near)).otherwise(near).alias("score"))


def _check(threshold: float) -> None:
    if not threshold > 0:
        raise ValueError("slots without a block in common score 0 and are not compared")


def _taking_part() -> Column:
    hollow = (F.col("side") == "p") & (F.col("kind") == "BRANCH") & (F.coalesce(F.size("primary"), F.lit(0)) <= 0) & (F.coalesce(F.size("context"), F.lit(0)) <= 0)
    return (F.col("sid") != 0) & ~F.coalesce(hollow, F.lit(False))


def _by_size(slots: DataFrame, by: str) -> tuple[DataFrame, DataFrame | None]:
    """slots of functions of up to WHOLE slots, and those of the others (and of no function) if there are any."""
    large = slots.groupBy(by).agg(F.count("*").alias("_n")).where((F.col("_n") > WHOLE) | F.col(by).isNull()).select(F.col(by).alias("_by"))
    if large.isEmpty():
        return slots, None
    same = F.col(by).eqNullSafe(F.col("_by"))
    return slots.join(large, same, "left_anti"), slots.join(large, same, "left_semi")


def _score(x: Column) -> Column:
    """As in slot_scores, of two slots that have so many blocks and so many in common."""
    jaccard = lambda c: F.when(x[f"n_{c}"] == 0, 1.0).otherwise(x[c] / (x[f"n_{c}"] - x[c]))
    return F.when(x["n_primary"] > 0, F.greatest(jaccard("primary"), 0.5 * jaccard("context"))).otherwise(jaccard("context"))


def _matched_whole(slots: DataFrame, by: str, threshold: float, gap: float) -> DataFrame:
    """Functions in one row each: (by, n_predicted, n_wanted, matches, left), matches and left as `matched_slots` has them. Slots are shuffled once, or not at all if they were dealt by function."""
    slot = F.when(_taking_part(), F.struct("sid", "side", "kind", _blocks("primary"), _blocks("context")))
    rows = slots.groupBy(by).agg(F.count_if(F.col("side") == "p").alias("n_predicted"), F.count_if(F.col("side") == "w").alias("n_wanted"), F.sort_array(F.collect_list(slot)).alias("slots"))
    of = lambda name, side: F.filter(name, lambda s: s["side"] == side)
    conditions = lambda side: F.filter("slots", lambda s: (s["side"] == side) & (s["kind"] == "COND"))
    rows = rows.withColumns({"p": conditions("p"), "w": conditions("w")}).withColumn("n", F.least(F.size("p"), F.size("w")))
    match = lambda p, w, score, method: F.struct(p.alias("predicted"), w.alias("wanted"), score.alias("score"), F.lit(method).alias("method"))
    rows = rows.withColumn("ordered", F.zip_with(F.slice("p", 1, F.col("n")), F.slice("w", 1, F.col("n")), lambda p, w: match(p["sid"], w["sid"], F.lit(1.0), "cond_order")))
    among = lambda pairs, s: F.when(s["side"] == "p", F.array_contains(F.col(f"{pairs}.predicted"), s["sid"])).when(s["side"] == "w", F.array_contains(F.col(f"{pairs}.wanted"), s["sid"])).otherwise(False)
    rows = rows.withColumn("slots", F.filter("slots", lambda s: ~among("ordered", s))).withColumns({"p": of("slots", "p"), "w": of("slots", "w")})

    def offer(p: Column) -> Column:
        common = lambda w, c: (F.size(F.array_intersect(p[c], w[c])).alias(c), (F.size(p[c]) + F.size(w[c])).alias(f"n_{c}"))
        pairs = F.transform(F.filter("w", lambda w: w["kind"] == p["kind"]), lambda w: F.struct(w["sid"].alias("w"), *common(w, "primary"), *common(w, "context")))
        scores = F.transform(pairs, lambda x: F.struct(_score(x).alias("score"), x["w"].alias("w")))
        return F.struct(p["sid"].alias("p"), F.sort_array(F.filter(scores, lambda x: x["score"] >= threshold), False).alias("best"))

    def first(o: Column) -> Column:
        best, second = F.get(o["best"], F.lit(0)), F.get(o["best"], F.lit(1))
        return F.struct(best["w"].alias("w"), best["score"].alias("score"), o["p"].alias("p"), F.coalesce(best["score"] - second["score"] < gap, F.lit(False)).alias("ambiguous"))

    rows = rows.withColumn("offers", F.transform("p", offer)).withColumn("offers", F.filter("offers", lambda o: F.size(o["best"]) > 0)).withColumn("offers", F.transform("offers", first))
    higher = lambda q, o: (q["w"] == o["w"]) & ((q["score"] > o["score"]) | ((q["score"] == o["score"]) & (q["p"] > o["p"])))
    taken = F.filter("offers", lambda o: ~F.exists("offers", lambda q: higher(q, o)))
    rows = rows.withColumn("taken", taken).withColumn("overlap", F.transform("taken", lambda o: match(o["p"], o["w"], F.round(o["score"], 4), "bb_overlap")))
    rows = rows.withColumn("unsure", F.filter("offers", lambda o: o["ambiguous"])["p"])
    state = lambda s: F.struct(s["side"].alias("side"), s["sid"].alias("sid"), (~among("overlap", s)).alias("left"), F.coalesce((s["side"] == "p") & F.array_contains("unsure", s["sid"]), F.lit(False)).alias("ambiguous"))
    rows = rows.withColumn("left", F.transform("slots", state)).withColumn("left", F.filter("left", lambda s: s["left"] | s["ambiguous"]))
    return rows.select(by, "n_predicted", "n_wanted", F.concat("ordered", "overlap").alias("matches"), "left")


def _matched_joined(slots: DataFrame, by: str, threshold: float, gap: float) -> tuple[DataFrame, DataFrame]:
    slots = slots.where(_taking_part())
    place = F.row_number().over(Window.partitionBy(by, "side").orderBy("sid"))
    conditions = slots.where("kind = 'COND'").select(by, "side", "sid", place.alias("place"))
    side = lambda x, name: conditions.where(F.col("side") == x).select(by, "place", F.col("sid").alias(name))
    ordered = side("p", "predicted").join(side("w", "wanted"), [by, "place"]).select(by, "predicted", "wanted")
    used = ordered.select(by, F.explode(F.array(F.struct(F.lit("p").alias("side"), F.col("predicted").alias("sid")), F.struct(F.lit("w").alias("side"), F.col("wanted").alias("sid")))).alias("x")).select(by, "x.*")
    open_ = slots.join(used, [by, "side", "sid"], "left_anti")
    scores = slot_scores(open_, by).where(F.col("score") >= threshold)
    two = scores.withColumn("k", F.row_number().over(Window.partitionBy(by, "p").orderBy(F.desc("score"), F.desc("w"))))
    best = F.max(F.when(F.col("k") == 1, F.struct("score", "w")))
    offers = two.where("k <= 2").groupBy(by, "p").agg(best.alias("x"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"))
    offers = offers.select(by, "p", "x.score", "x.w", F.coalesce(F.col("x.score") - F.col("second") < gap, F.lit(False)).alias("ambiguous"))
    taken = offers.groupBy(by, "w").agg(F.max(F.struct("score", "p")).alias("x"))
    overlap = taken.select(by, F.col("x.p").alias("predicted"), F.col("w").alias("wanted"), F.round("x.score", 4).alias("score"), F.lit("bb_overlap").alias("method"))
    matches = ordered.select(by, "predicted", "wanted", F.lit(1.0).alias("score"), F.lit("cond_order").alias("method")).unionByName(overlap)
    gone = overlap.select(by, F.lit("p").alias("side"), F.col("predicted").alias("sid")).unionByName(overlap.select(by, F.lit("w").alias("side"), F.col("wanted").alias("sid")))
    unsure = offers.where("ambiguous").select(by, F.lit("p").alias("side"), F.col("p").alias("sid"), F.lit(True).alias("ambiguous"))
    left = open_.select(by, "side", "sid").join(gone.withColumn("_gone", F.lit(True)), [by, "side", "sid"], "left").join(unsure, [by, "side", "sid"], "left")
    return matches, left.where("_gone IS NULL OR ambiguous").select(by, "side", "sid", F.col("_gone").isNull().alias("left"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def matched_slots(slots: DataFrame, by: str, threshold: float = 0.5, gap: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Matches (by, predicted, wanted, score, method) and left-overs (by, side, sid, ambiguous) of slots (by, side 'p' or 'w', sid, kind, primary, context).

    Slot 0 and predicted branches without blocks take no part. Conditions match by their order. Of the others each predicted slot offers the wanted one of the highest score, `threshold` (over 0) or
    more, and each wanted one takes the highest offer; of ties the larger sid. `ambiguous` says that a slot's second best is nearer than `gap` and within the threshold, too.
    """
    _check(threshold)
    small, large = _by_size(slots, by)
    rows = _matched_whole(small, by, threshold, gap)
    # the outer form, because before the inner one Spark filters by size, for which it makes the arrays twice
    found = rows.select(by, F.inline_outer("matches")).where("method IS NOT NULL"), rows.select(by, F.inline_outer("left")).where("left IS NOT NULL")
    if large is None:
        return found
    matches, left = _matched_joined(large, by, threshold, gap)
    return found[0].unionByName(matches), found[1].unionByName(left)


def slot_audit(slots: DataFrame, by: str, threshold: float = 0.5, gap: float = 0.1) -> DataFrame:
    """Per function: n_predicted, n_wanted, n_matched, n_by_order, n_left (predicted), n_open (wanted), n_ambiguous and mean_score of the matches."""
    _check(threshold)
    small, large = _by_size(slots, by)
    out = _audit_whole(_matched_whole(small, by, threshold, gap), by)
    return out if large is None else out.unionByName(_audit_joined(large, by, threshold, gap))


def _audit_whole(rows: DataFrame, by: str) -> DataFrame:
    n = lambda name, has: F.size(F.filter(name, has)).cast("long")
    left = lambda side: n("left", lambda s: s["left"] & (s["side"] == side))
    total = F.aggregate("matches", F.lit(0.0), lambda a, m: a + m["score"])
    mean = F.round(F.when(F.size("matches") > 0, total / F.size("matches")), 4)
    return rows.select(
        by, "n_predicted", "n_wanted", F.size("matches").cast("long").alias("n_matched"), n("matches", lambda m: m["method"] == "cond_order").alias("n_by_order"), mean.alias("mean_score"),
        left("p").alias("n_left"), left("w").alias("n_open"), n("left", lambda s: s["ambiguous"]).alias("n_ambiguous"),
    )


def _audit_joined(slots: DataFrame, by: str, threshold: float, gap: float) -> DataFrame:
    matches, left = _matched_joined(slots, by, threshold, gap)
    n = lambda c: F.sum(F.col(c).cast("int")).cast("long")
    a = matches.withColumn("_o", F.col("method") == "cond_order").groupBy(by).agg(F.count("*").alias("n_matched"), n("_o").alias("n_by_order"), F.round(F.avg("score"), 4).alias("mean_score"))
    b = left.select(by, (F.col("left") & (F.col("side") == "p")).alias("_p"), (F.col("left") & (F.col("side") == "w")).alias("_w"), "ambiguous").groupBy(by).agg(n("_p").alias("n_left"), n("_w").alias("n_open"), n("ambiguous").alias("n_ambiguous"))
    c = slots.groupBy(by).agg(F.count_if(F.col("side") == "p").alias("n_predicted"), F.count_if(F.col("side") == "w").alias("n_wanted"))
    return c.join(a, by, "left").join(b, by, "left").na.fill(0, ["n_matched", "n_by_order", "n_left", "n_open", "n_ambiguous"])


def report_rows(texts: DataFrame, header: str, pattern: str, names: list[str]) -> DataFrame:
    """Rows back out of text reports (file, text): of each line with the pattern its groups by name, with the last header line's group before it as `section`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        head, row = re.compile(header), re.compile(pattern)
        for pdf in batches:
            out = []
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                section = None
                for k, line in enumerate((text or "").split("\n")):
                    if m := head.search(line):
                        section = m.group(1)
                    elif m := row.search(line):
                        out.append((file, k + 1, section, *m.groups()))
            yield pd.DataFrame(out, columns=["file", "line_no", "section", *names])

    return texts.select("file", "text").mapInPandas(run, "file string, line_no bigint, section string, " + ", ".join(f"`{n}` string" for n in names))


def injected(candidates: DataFrame, projected: DataFrame, slots: DataFrame, by: list[str], least: int, tier: Column) -> tuple[DataFrame, DataFrame]:
    """(new candidates, reasons) of projecting a source's text (by, text, ...) onto slots (by): a slot whose projection has at least a tier's rank and a text that none of its candidates (by, text)
    has gets one, with a stable id. Reasons count slots: injected, no_projection, text_exists; ties within a slot's projections go to the largest tier, then the smallest text.
    """
    best = projected.where((tier >= least) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select(*by, F.trim("text").alias("text"), tier.alias("_t"))
    best = best.groupBy(*by).agg(F.min_by("text", F.struct((-F.col("_t")).alias("t"), "text")).alias("text"))
    known = candidates.select(*by, F.col("text")).distinct().withColumn("_known", F.lit(True))
    x = slots.select(*by).distinct().join(best, by, "left").join(known, [*by, "text"], "left")
    reason = F.when(F.col("text").isNull(), "no_projection").when(F.col("_known"), "text_exists").otherwise("injected")
    x = x.withColumn("reason", reason)
    stable = F.concat(F.lit("srcproj_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in by], "text"), 256), 1, 14))
    return x.where("reason = 'injected'").select(*by, stable.alias("candidate_id"), "text"), x.groupBy("reason").agg(F.count("*").alias("n"))


def proxy_blocks(blocks: DataFrame, edges: DataFrame, sample: str = "sample") -> DataFrame:
    """Blocks (sample, b, first, length) as proxies of lifted ones: instruction range, neighbours (distinct, in order) and terminator: return without successors, cond_branch with several, else jump."""
    out = edges.groupBy(sample, F.col("src").alias("b")).agg(F.array_sort(F.collect_set("dst")).alias("successors"))
    into = edges.groupBy(sample, F.col("dst").alias("b")).agg(F.array_sort(F.collect_set("src")).alias("predecessors"))
    x = blocks.join(out, [sample, "b"], "left").join(into, [sample, "b"], "left")
    x = x.withColumns({"successors": F.coalesce("successors", F.array().cast("array<bigint>")), "predecessors": F.coalesce("predecessors", F.array().cast("array<bigint>"))})
    n = F.size("successors")
    ends = F.when(n == 0, "return").when(n >= 2, "cond_branch").otherwise("jump")
    return x.select(sample, "b", F.col("first").alias("start"), (F.col("first") + F.col("length")).alias("end"), "predecessors", "successors", ends.alias("terminator"), (n == 0).alias("has_return"))


def parser_metrics(nodes: DataFrame, outlines: DataFrame, ignored: int = -100) -> DataFrame:
    """One row of accuracies. nodes: control, control_predicted, role, role_predicted, slot, slot_predicted (a target of `ignored` does not count). outlines: graph, place, kind,
    kind_predicted (0 for none): accuracy of kinds where there is one, of the number of kinds, and of whole sequences. Rates without any row are 0.
    """
    hit = lambda t, p, where: F.coalesce(F.avg(F.when(where, (F.col(t) == F.col(p)).cast("double"))), F.lit(0.0))
    c = F.col("control")
    a = nodes.agg(
        hit("control", "control_predicted", F.lit(True)).alias("control"), *[hit("control", "control_predicted", c == k).alias(f"{n}_recall") for k, n in ((1, "if"), (2, "loop"), (3, "switch"))],
        hit("role", "role_predicted", F.col("role") != ignored).alias("role"), hit("slot", "slot_predicted", F.col("slot") != ignored).alias("slot"),
    )
    kinds = outlines.agg(hit("kind", "kind_predicted", F.col("kind") != 0).alias("outline_kind"))
    per = outlines.groupBy("graph").agg(F.count_if(F.col("kind") != 0).alias("g"), F.count_if(F.col("kind_predicted") != 0).alias("p"))
    wrong = outlines.join(per, "graph").where((F.col("place") < F.col("g")) & (F.col("kind") != F.col("kind_predicted"))).select("graph").distinct().withColumn("_wrong", F.lit(True))
    s = per.join(wrong, "graph", "left")
    seq = s.agg(F.coalesce(F.avg((F.col("g") == F.col("p")).cast("double")), F.lit(0.0)).alias("outline_count"), F.coalesce(F.avg(((F.col("g") == F.col("p")) & F.col("_wrong").isNull()).cast("double")), F.lit(0.0)).alias("outline_sequence"))
    out = a.crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(seq))  # one row each
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])

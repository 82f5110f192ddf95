"""Queries on gates, contracts and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import contracts as C

from .tables import by_order, read

TYPES = ["COND", "BLOCK", "CASE", "GOTO", "UNSTRUCTURED_REGION", "odd", None]


def _pick(values: list, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def candidate_gate(spark: SparkSession, d: str) -> DataFrame:
    """A fact fails where a part's key is divisible by the fact's number."""
    p = read(spark, d, "part")
    facts = {k: F.when(F.col("p_partkey") % 13 != 12, F.col("p_partkey") % (i + 5) != 0) for i, k in enumerate(C.GATE)}
    return p.select("p_partkey", C.gate(facts).alias("g")).select("p_partkey", "g.passed", F.array_join("g.failed", ",").alias("failed"))


def slot_policies(spark: SparkSession, d: str) -> DataFrame:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    x = C.slot_policy(k % 11 != 0, _pick(TYPES, k % 7), _pick(TYPES, k % 7) == "GOTO", k % 5 == 0, k % 17 != 0, F.col("p_size") % 9, 3, 6)
    return p.select("p_partkey", x.alias("x")).select("p_partkey", "x.tier", "x.tier_name", "x.alignment", "x.weight", F.array_join("x.reasons", ",").alias("reasons"))


def spot_checks(spark: SparkSession, d: str) -> DataFrame:
    """Core records out of orders, broken in several ways."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    fill = lambda v, n: F.array_repeat(F.lit(v), n)
    n, bad = F.col("n"), F.col("flag") == "R"
    row = F.array_repeat(F.when(F.col("status") == "F", 0.0).otherwise(0.5), n)
    samples = lines.select(
        "l_orderkey", "n", fill(7, 2 * n).alias("bin_opcodes"), fill(1, 6 * n).alias("bin_operand_types"), fill(1, 6 * n).alias("bin_operand_values"), fill(2, F.when(n == 6, 5).otherwise(n)).alias("bin_block_lengths"),
        F.array(fill(0, F.when(n == 1, 0).otherwise(n)), fill(0, F.when(n == 1, 0).otherwise(n))).alias("bin_edge_index"), F.array_repeat(fill(0.0, F.when(n == 4, 11).otherwise(12)), n).alias("bin_struct_features"),
        fill(3, n).alias("src_token_ids"), fill(1, n).alias("src_stmt_lengths"), fill(3, n).alias("src_ast_types"), F.array(fill(0, F.lit(1)), fill(0, F.lit(1))).alias("src_edge_index"), F.array_repeat(fill(1, F.lit(1)), n).alias("block_src_lines"),
        F.array_repeat(row, n).alias("alignment_matrix"), F.array_repeat(row, F.when(n == 3, 2).otherwise(n)).alias("alignment_confidence"), fill(0, F.when(bad, n - 1).otherwise(n)).alias("pattern_labels"), F.col("status"),
    )
    out = C.spot_check(samples, {"consistent": n != 5, "coverage": F.when(F.col("status") == "F", 0.0).otherwise(1.0), "mean_conf": F.when(n == 2, 0.0).otherwise(0.5)})
    return out.select("l_orderkey", "grade", F.array_join("notes", ";").alias("notes"))


def instance_checks(spark: SparkSession, d: str) -> DataFrame:
    """Line items as instructions of an order's one block, a statement of six kinds."""
    l, k = by_order(spark, d), F.col("l_partkey")  # noqa: E741
    place = F.col("l_linenumber") * 100000 + k
    code = l.select(F.col("l_orderkey").alias("b"), place.alias("place"), _pick(["mov", "call", "cmp", "ret"], k % 4).alias("mnemonic"), F.when(k % 4 == 1, _pick(["foo@plt", "bar", "0x12", "foobar"], k % 3)).alias("call_target"), F.when(k % 4 == 2, F.array(k % 70, F.lit(1).cast("bigint"))).alias("immediates"))
    text = _pick(["foo(x);", "return bar(1);", "if (a != 65)", "x = 'A';", "}", " "], F.col("o_orderkey") % 6)
    statements = by_order(spark, d, "orders").select(F.col("o_orderkey").alias("b"), _pick(["call", "return_statement", "compound_statement"], F.col("o_custkey") % 3).alias("type"), text.alias("text"))
    return C.instance_checks(code, statements, ["b"])


def candidate_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates of four blocks, line items as slots."""
    k = F.col("l_partkey")
    slots = by_order(spark, d).select(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("slot_id"), _pick(["COND", "BLOCK", "GOTO", "BREAK"], F.col("l_suppkey") % 4).alias("slot_type"), F.when(k % 9 != 0, F.array(k % 5, (k + 2) % 4)).otherwise(F.array().cast("array<bigint>")).alias("primary"), F.array(k % 4).alias("context"))
    out = C.candidate_facts(slots, by_order(spark, d, "orders").select(F.col("o_orderkey").alias("c"), F.lit(4).alias("n_bb")), ["c"])
    return out.select("c", "invalid_refs", F.col("missing_blocks").cast("long").alias("missing_blocks"), "duplicate_blocks", "grounded", "n_goto", "n_break", F.array_join("fatal", ",").alias("fatal"))


def label_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("b")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("k"))
    blocks = rows.select("sample", "b", (F.col("k") % 9).cast("int").alias("role"), (F.col("p") % 3 == 0).alias("loop_line"), (F.col("p") % 4 == 0).alias("switch_line"), (F.col("p") % 6 == 0).alias("structural"))
    edges = rows.select("sample", F.col("b").alias("src"), (F.col("b") - 1).alias("dst"), (F.col("k") % 3).cast("int").alias("etype"))
    sources = read(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 3).alias("n_loops"), (F.col("o_custkey") % 2).alias("n_switches"))
    return C.label_diagnosis(blocks, edges, sources)


def readiness_labels(spark: SparkSession, d: str) -> DataFrame:
    """A report for each customer of some orders."""
    o = read(spark, d, "orders").withColumns({"x": F.col("o_totalprice") / 400000, "u": F.col("o_orderpriority") == "1-URGENT"})
    s = o.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("x") > 0.01).alias("hard"), F.count_if(F.col("x") > 1.1).alias("false"), F.count_if(F.col("x") > 0.05).alias("ssa"), F.round(F.avg(0.88 + F.col("x") / 5), 6).alias("ground"), F.count_if(F.col("x") > 0.2).alias("safe"),
        F.count_if(F.col("x") > 0.1).alias("pool"), F.count_if(F.col("x") > 0.15).alias("ready"), F.count_if(F.col("x") > 0.9).alias("fallback"), F.round(F.avg(F.col("o_custkey") % 3), 6).alias("goto"), F.round(F.avg(F.col("x") + 0.6), 6).alias("cov"),
        F.count_if("u").alias("switch_n"), F.count_if(F.col("u") & (F.col("x") > 0.4)).alias("switch_ready"), F.count_if(F.col("x") > 0.5).alias("large_n"), F.count_if(F.col("x") > 0.7).alias("large_ready"),
    )
    names = {"n": "n", "hard_contract_pass": "hard", "false_verified": "false", "real_ssa": "ssa", "condition_slot_grounded_rate": "ground", "branch_provenance_coverage": "ground", "safe": "safe", "any_safe": "pool", "ready": "ready", "fallback_functions": "fallback", "goto_mean": "goto", "structured_coverage": "cov", "switch_n": "switch_n", "switch_ready": "switch_ready", "large_n": "large_n", "large_ready": "large_ready"}
    return s.select("o_custkey", C.readiness({k: F.col(v) for k, v in names.items()}).alias("r")).select("o_custkey", "r.label", F.size("r.reasons").cast("long").alias("n_reasons"), F.coalesce(F.get("r.reasons", F.lit(0)), F.lit("")).alias("first_reason"))


def token_file_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("file"), F.min("l_suppkey").alias("k"), F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("l_partkey"))).alias("ids"))
    bucket = _pick(["readable", "readable", "weak_fallback", "no_src", "unresolvable", "empty_file", "unreadable_nonempty", None], F.col("k") % 8)
    return C.token_file_audit(rows.withColumn("bucket", bucket), "file", F.col("bucket"), "ids", 1900)


def structural_targets(spark: SparkSession, d: str) -> DataFrame:
    p, k, x = read(spark, d, "part"), F.col("p_partkey"), F.col("p_size") / 50
    cfg = {"available": k % 3 == 0, "score": x, "recall": F.least(F.lit(1.0), x + 0.2), "f1": x, "fallback": x / 4, "escape": x / 8}
    t = C.structural_target(k % 10 != 0, k % 7 != 0, k % 2 == 0, F.least(F.lit(1.0), x + 0.2), F.least(F.lit(1.0), x + 0.3), k % 4, x / 3, k % 3, k % 5, cfg)
    rows = p.select("p_partkey", t.alias("t"), C.rank_quality(t, F.lit(3.0), x, x, cfg).alias("quality"))
    return rows.select("p_partkey", "t.score", "t.tier", "t.status", "t.trainable", "t.confidence", "t.exact", "t.soft", F.round("quality", 4).alias("quality"))


def quality_components(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a part are 1, or lower by a share of its size, or missing; counts are remainders of its key."""
    k, x = F.col("p_partkey"), F.col("p_size") / 500
    facts = {n: F.when(k % (i + 7) != 0, 1 - x) for i, n in enumerate(C.QUALITY_RATES)} | {n: F.when(k % (i + 3) == 1, 1) for i, n in enumerate(C.QUALITY_COUNTS)}
    facts |= {n: k % (i + 4) != 0 for i, n in enumerate((*C.QUALITY_FACTS, "valid", "bb_coverage_ok"))} | {"fallback_bb_count": k % 4, "slot_count": F.col("p_size"), "structured_bb_count": k % 11}
    return read(spark, d, "part").select("p_partkey", C.quality_components(facts, k % 12, k % 5 != 0).alias("x")).select("p_partkey", "x.*")


def audit_tasks(spark: SparkSession, d: str) -> DataFrame:
    l = by_order(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("fill "), F.col("l_suppkey").cast("string")).alias("text")).distinct()  # noqa: E741
    return C.audit_tasks(l, ["l_orderkey", "l_partkey"], "text", [F.col("l_linenumber"), F.col("l_partkey"), F.col("text")]).select("l_orderkey", "l_linenumber", "task_id", F.col("candidate_rank").cast("long").alias("candidate_rank"), "target_text", "verdict")


def rendered_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Orders as skeletons with a condition and two statements, line items as candidates of the first two slots."""
    text = F.concat(F.lit("if (<FILL_COND:slot_1>) { <FILL_STMT:slot_2> ; } /* "), F.col("o_orderstatus"), F.lit(" */"), F.when(F.col("o_custkey") % 4 == 0, "<FILL_STMT:slot_3>").otherwise(""))
    skeletons = read(spark, d, "orders").select(F.col("o_orderkey").alias("f"), F.when(F.col("o_custkey") % 9 != 0, text).alias("skeleton"))
    words = ["x > 1", "y = 2", "z;", "{ }", "/* c */", " "]
    cands = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("f"), F.concat(F.lit("slot_"), (F.col("l_linenumber") % 2 + 1).cast("string")).alias("slot_id"), F.concat(F.col("l_partkey"), F.lit("."), F.col("l_suppkey")).alias("candidate_id"), (F.col("l_suppkey") % 3).alias("rank"), F.col("l_discount").alias("weight"), _pick(words, F.col("l_partkey") % 6).alias("text"))
    return C.rendered(skeletons, cands, "f")


def _slots(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("k"), F.array().cast("array<bigint>")
    slots = by_order(spark, d).groupBy(F.col("l_orderkey").alias("f"), (F.col("l_linenumber") - 1).cast("long").alias("sid")).agg(F.min("l_partkey").alias("k"), F.min("l_suppkey").alias("s"))
    kind = F.when(k % 3 == 0, "COND").when(k % 11 == 0, "BRANCH").otherwise("BLOCK")
    return slots.select("f", F.when(F.col("s") % 2 == 0, "p").otherwise("w").alias("side"), "sid", kind.alias("kind"), F.when(k % 5 == 0, none).otherwise(F.array(k % 3, k % 4)).alias("primary"), F.when(k % 7 < 2, none).otherwise(F.array(k % 2)).alias("context"))


def matched_slots(spark: SparkSession, d: str) -> DataFrame:
    return C.matched_slots(_slots(spark, d), "f", 0.4)[0]


def slot_audit(spark: SparkSession, d: str) -> DataFrame:
    return C.slot_audit(_slots(spark, d), "f", 0.4, 0.2)


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Counts that were rendered into a text report, read back."""
    rows = read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("  "), "o_orderpriority", F.lit(": "), F.col("n").cast("string"), F.lit(" rows"))
    text = rows.groupBy(F.col("o_orderstatus").alias("file")).agg(F.concat(F.lit("== status "), F.first("o_orderstatus"), F.lit(" ==\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\nend")).alias("text"))
    return C.report_rows(text, r"^== status (\w+) ==$", r"^\s+(\S+(?: \S+)*): (\d+) rows$", ["priority", "n"]).select("section", "priority", F.col("n").cast("long").alias("n"), "line_no")


def _injected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l = read(spark, d, "lineitem")  # noqa: E741
    slots = l.select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("slot"))
    candidates = l.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("slot"), F.concat(F.lit("t"), (F.col("l_suppkey") % 4).cast("string")).alias("text"))
    projected = l.where("l_discount > 0.03").select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("slot"), F.when(F.col("l_partkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" t"), (F.col("l_partkey") % 4).cast("string"))).alias("text"), (F.col("l_partkey") % 5).alias("tier"))
    return C.injected(candidates, projected, slots, ["f", "slot"], 1, F.col("tier"))


def injected_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _injected(spark, d)[0]


def injection_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _injected(spark, d)[1]


def proxy_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("b")).agg(F.min("l_partkey").alias("first"), F.min("l_suppkey").alias("k"))
    edges = rows.withColumn("j", F.explode(F.sequence(F.lit(1), (F.col("k") % 3 + 1).cast("int")))).where("j <= k % 3").select("sample", F.col("b").alias("src"), (F.col("b") + F.col("j")).alias("dst"))
    out = C.proxy_blocks(rows.select("sample", "b", "first", (F.col("k") % 9).alias("length")), edges)
    return out.withColumns({c: F.array_join(c, ",") for c in ("predecessors", "successors")}).withColumnRenamed("end", "stop")


def parser_metrics(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    hidden = lambda c: F.when(k % 6 == 0, -100).otherwise(c)
    l = read(spark, d, "lineitem")  # noqa: E741
    nodes = l.select((k % 4).alias("control"), (s % 4).alias("control_predicted"), hidden(k % 3).alias("role"), (s % 3).alias("role_predicted"), hidden(k % 2).alias("slot"), (s % 2).alias("slot_predicted"))
    rows = l.groupBy(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("k"))
    outlines = rows.select("graph", (F.col("n") - 1).alias("place"), F.when(F.col("n") <= 2, F.col("k") % 2 + 1).otherwise(0).alias("kind"), F.when(F.col("n") <= F.when(F.col("graph") % 3 == 0, 3).otherwise(2), F.when(F.col("k") % 5 == 0, 1).otherwise(F.col("k") % 2 + 1)).otherwise(0).alias("kind_predicted"))
    return C.parser_metrics(nodes, outlines)


QUERIES = {
    f.__name__: f
    for f in (candidate_gate, slot_policies, spot_checks, instance_checks, candidate_facts, label_diagnosis, readiness_labels, token_file_audit, quality_components, structural_targets, audit_tasks, rendered_skeletons, matched_slots, slot_audit, report_rows, injected_candidates, injection_reasons, proxy_blocks, parser_metrics)
}

_INJECT = """s AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS slot FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS slot, 't' || l_suppkey % 4 AS text FROM lineitem WHERE l_returnflag <> 'N'),
    p AS (SELECT l_orderkey AS f, l_linenumber AS slot, 't' || l_partkey % 4 AS text FROM lineitem WHERE l_discount > 0.03 AND l_partkey % 7 <> 0 AND l_partkey % 5 >= 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey % 5 DESC, 't' || l_partkey % 4) = 1),
    r AS (SELECT s.f, s.slot, p.text, CASE WHEN p.text IS NULL THEN 'no_projection' WHEN c.text IS NOT NULL THEN 'text_exists' ELSE 'injected' END AS reason FROM s LEFT JOIN p USING (f, slot) LEFT JOIN c ON c.f = s.f AND c.slot = s.slot AND c.text = p.text)"""
# what counts in a candidate's quality, with its weight, and what a gate asks for, written out by hand in the order in which the query makes them
_RATE_WEIGHTS = [
    ("structured_bb_ratio", "28"), ("structured_control_ratio", "6"), ("edge_semantic_ratio", "8"), ("edge_explicit_ratio", "3"), ("edge_interval_ratio", "4"), ("edge_linear_ratio", "1.5"), ("slot_pointer_acc", "10"), ("branch_header_cond_slot_coverage", "8"),
    ("cond_pointer_acc", "5"), ("block_pointer_acc", "3"), ("goto_pointer_acc", "1"), ("condition_slot_grounded_rate", "7"), ("branch_provenance_coverage", "4"), ("condition_branch_metadata_rate", "3"), ("condition_ssa_available_rate", "2"),
    ("real_condition_ssa_available_rate", "2"), ("if_cond_grounded_rate", "1"), ("loop_cond_grounded_rate", "1"), ("switch_cond_grounded_rate", "1"), ("condition_polarity_available_rate", "1.5"), ("slot_locality_score", "8"), ("edge_goto_ratio", "-5"),
    ("edge_break_ratio", "-1.2"), ("edge_continue_ratio", "-0.8"), ("edge_early_exit_ratio", "-1"), ("edge_fallback_ratio", "-3"), ("edge_uncovered_ratio", "-20"), ("branch_header_cond_slot_gap", "-12"),
]
_COUNT_WEIGHTS = [("fallback_region_count", "-2.5"), ("goto_count", "-1.8"), ("break_count", "-0.35"), ("continue_count", "-0.2"), ("early_exit_count", "-0.45"), ("cleanup_exit_count", "-0.35"), ("empty_control_with_context_count", "-20"), ("empty_control_count", "-4"), ("body_bb_outside_control_count", "-3")]
_FACT_WEIGHTS = [("strict_edge_preservation_ok", "2"), ("edge_preservation_ok", "1"), ("parse_success", "0.5"), ("slot_grounding_ok", "0.5")]
_GATE = "validator_valid bb_coverage_ok edge_preservation_ok strict_edge_preservation_ok slot_grounding_ok parse_success fatal_error_zero slot_locality_ready empty_control_with_context_zero body_bb_outside_control_zero skeleton_slot_lowerer_success contract_consistency_pass".split()
_DEFAULTS = {"slot_locality_score": "1", "branch_header_cond_slot_coverage": "1", "structured_bb_ratio": "(p_partkey % 11) / greatest(1, p_partkey % 12)", "branch_header_cond_slot_gap": "greatest(0, 1 - branch_header_cond_slot_coverage)"}
_RATES = ", ".join(f"coalesce(CASE WHEN p_partkey % {i + 7} <> 0 THEN 1 - p_size / 500 END, {_DEFAULTS.get(n, '0')}) AS {n}" for i, (n, _) in enumerate(_RATE_WEIGHTS))
_COUNTS = ", ".join(f"CASE WHEN p_partkey % {i + 3} = 1 THEN 1 ELSE 0 END AS {n}" for i, (n, _) in enumerate(_COUNT_WEIGHTS))
_HOLDS = ", ".join(f"p_partkey % {i + 4} <> 0{' OR p_partkey % 4 <> 0' if n == 'edge_preservation_ok' else ''} AS {n}" for i, n in enumerate([*(n for n, _ in _FACT_WEIGHTS), "valid", "bb_coverage_ok"]))
_GOOD = " + ".join([*(f"({w}) * {n}" for n, w in _RATE_WEIGHTS + _COUNT_WEIGHTS), *(f"{w} * {n}::INT" for n, w in _FACT_WEIGHTS)])
_FACT = ", ".join(f"CASE WHEN p_partkey % 13 = 12 OR p_partkey % {i + 5} = 0 THEN '{k}' END" for i, k in enumerate(_GATE))
_SLOTS = """r AS (SELECT l_orderkey AS f, CAST(l_linenumber - 1 AS BIGINT) AS sid, min(l_partkey) AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
    z AS (SELECT f, sid, s % 2 = 0 AS p, CASE WHEN k % 3 = 0 THEN 'COND' WHEN k % 11 = 0 THEN 'BRANCH' ELSE 'BLOCK' END AS kind, CASE WHEN k % 5 = 0 THEN [] ELSE list_distinct([k % 3, k % 4]) END AS a, CASE WHEN k % 7 < 2 THEN [] ELSE [k % 2] END AS b FROM r),
    x AS (SELECT * FROM z WHERE sid <> 0 AND NOT (p AND kind = 'BRANCH' AND len(a) = 0 AND len(b) = 0)), c AS (SELECT *, row_number() OVER (PARTITION BY f, p ORDER BY sid) AS n FROM x WHERE kind = 'COND'),
    o AS (SELECT f, i.sid AS predicted, j.sid AS wanted FROM c i JOIN c j USING (f, n) WHERE i.p AND NOT j.p),
    y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.f = x.f AND x.sid = CASE WHEN x.p THEN predicted ELSE wanted END AND x.kind = 'COND')),
    q AS (SELECT f, i.sid AS p, j.sid AS w, len(i.a) + len(j.a) > 0 AS has, coalesce(len(list_intersect(i.a, j.a)) / nullif(len(list_distinct(i.a || j.a)), 0), 1) AS ja, coalesce(len(list_intersect(i.b, j.b)) / nullif(len(list_distinct(i.b || j.b)), 0), 1) AS jb FROM y i JOIN y j USING (f, kind) WHERE i.p AND NOT j.p),
    s AS (SELECT *, CASE WHEN has THEN greatest(ja, 0.5 * jb) ELSE jb END AS score FROM q), k AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WHERE score >= 0.4 WINDOW w AS (PARTITION BY f, p ORDER BY score DESC, w DESC)),
    b AS (SELECT * FROM k WHERE n = 1), t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY f, w ORDER BY score DESC, p DESC) = 1),
    m AS (SELECT f, predicted, wanted, CAST(1 AS DOUBLE) AS score, 'cond_order' AS method FROM o UNION ALL SELECT f, p, w, round(score, 4), 'bb_overlap' FROM t)"""
ORACLES = {
    "candidate_gate": f"SELECT p_partkey, concat_ws(',', {_FACT}) = '' AS passed, concat_ws(',', {_FACT}) AS failed FROM part",
    "slot_policies": """WITH x AS (SELECT *, upper(coalesce(['COND', 'BLOCK', 'CASE', 'GOTO', 'UNSTRUCTURED_REGION', 'odd', NULL][p_partkey % 7 + 1], '')) AS k FROM part),
             y AS (SELECT *, concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'b_gate_failed' END, CASE WHEN p_partkey % 17 = 0 THEN 'missing_skeleton_anchor' END, CASE WHEN k = 'UNSTRUCTURED_REGION' THEN 'unsupported_unstructured_region' END, CASE WHEN k IN ('ODD', '') THEN 'unknown_slot_type' END) AS w FROM x),
             z AS (SELECT *, CASE WHEN w <> '' THEN 0 WHEN k = 'GOTO' THEN 1 WHEN p_partkey % 5 = 0 THEN 2 WHEN p_size % 9 <= 3 THEN 3 WHEN p_size % 9 <= 6 THEN 4 ELSE 5 END AS c FROM y)
        SELECT p_partkey, ['C0', 'C1', 'C2', 'C2', 'C1', 'C0'][c + 1] AS tier, ['invalid_or_unmatched', 'binary_only_or_template_prior', 'cfg_liveout_compatible_weak', 'contract_ready_needs_candidate_validator', 'heuristic_prior_escape_moderate', 'too_ambiguous_for_o0'][c + 1] AS tier_name,
               CAST([0.0, 0.25, 0.45, 0.6, 0.35, 0.0][c + 1] AS DOUBLE) AS alignment, CAST([0.0, 0.0, 0.2, 0.2, 0.0, 0.0][c + 1] AS DOUBLE) AS weight,
               CASE c WHEN 0 THEN w WHEN 1 THEN 'escape_or_control_transfer_slot' WHEN 2 THEN 'module_b_repair_slot_requires_extra_validation' WHEN 3 THEN 'contract_ready_but_no_slot_label_candidate_validated' WHEN 4 THEN 'moderate_function_escape_count' ELSE 'escape_heavy_function_requires_later_global_validation' END AS reasons FROM z""",
    "spot_checks": """WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_returnflag) = 'R' AS r, max(l_linestatus) = 'F' AS z FROM lineitem GROUP BY 1),
             f AS (SELECT *, concat_ws(';', CASE WHEN n = 6 THEN 'features do not match blocks' END, CASE WHEN n = 4 THEN 'features are not 12' END, CASE WHEN n = 6 THEN 'block lengths do not sum to instructions;lines do not match blocks;alignment rows do not match blocks' END,
                   CASE WHEN n = 3 THEN 'confidence is shaped unlike the matrix' END, CASE WHEN n = 6 AND NOT r OR n <> 6 AND r THEN 'labels do not match blocks' END, CASE WHEN n = 5 THEN 'lines without mass' END) AS bad,
                   concat_ws(';', CASE WHEN n = 1 THEN 'no edges' END, CASE WHEN z THEN 'matrix is zero;no block is covered' END, CASE WHEN n = 2 AND NOT z THEN 'covered without confidence' END) AS warn FROM l)
        SELECT l_orderkey, CASE WHEN bad <> '' THEN 'FAIL' WHEN warn <> '' THEN 'WARN' ELSE 'PASS' END AS grade, CASE WHEN bad <> '' THEN bad ELSE warn END AS notes FROM f""",
    "instance_checks": """WITH i AS (SELECT l_orderkey AS b, l_linenumber * 100000 + l_partkey AS place, l_partkey % 4 AS m, CASE WHEN l_partkey % 4 = 1 THEN ['foo', 'bar', '0x12'][l_partkey % 3 + 1] END AS c, l_partkey % 70 AS v FROM lineitem),
             s AS (SELECT o_orderkey AS b, ['call', 'return_statement', 'compound_statement'][o_custkey % 3 + 1] AS type, o_orderkey % 6 AS t FROM orders), x AS (SELECT i.*, type, t FROM i JOIN s USING (b) WHERE t <> 5),
             calls AS (SELECT b, CASE WHEN t = 0 AND c = 'foo' OR t = 1 AND c = 'bar' THEN 1.0 ELSE 0.0 END AS score FROM x WHERE m = 1 AND c <> '0x12'),
             rets AS (SELECT b, CASE WHEN t IN (1, 4) OR type IN ('return_statement', 'compound_statement') THEN 1.0 ELSE 0.0 END AS score FROM (SELECT b, arg_max(m, place) AS m, any_value(type) AS type, any_value(t) AS t FROM x GROUP BY b) WHERE m = 3),
             vals AS (SELECT b, v, ['foo(x);', 'return bar(1);', 'if (a != 65)', 'x = ''A'';', '}'][t + 1] AS text FROM (SELECT b, t, v FROM x WHERE m = 2 UNION ALL SELECT b, t, 1 FROM x WHERE m = 2) WHERE v <> 0),
             imms AS (SELECT b, CASE WHEN contains(text, CAST(v AS VARCHAR)) OR contains(text, '0x' || lower(to_hex(v))) OR (v BETWEEN 32 AND 126 AND contains(text, '''' || chr(CAST(v AS INTEGER)) || '''')) OR (v = 1 AND contains(text, '!=')) THEN 1.0 ELSE 0.5 END AS score FROM vals),
             a AS (SELECT b, count(*) AS checks, avg(score) AS score FROM (SELECT * FROM calls UNION ALL SELECT * FROM rets UNION ALL SELECT * FROM imms) GROUP BY 1)
        SELECT d.b, CASE WHEN d.b NOT IN (SELECT b FROM x) THEN 'NODATA' WHEN checks IS NULL THEN 'SKIP' WHEN score >= 0.9 THEN 'MATCH' WHEN score >= 0.5 THEN 'PARTIAL' ELSE 'MISMATCH' END AS verdict, coalesce(checks, 0) AS checks, round(score, 6) AS score FROM (SELECT DISTINCT b FROM i) d LEFT JOIN a USING (b)""",
    "candidate_facts": """WITH s AS (SELECT l_orderkey AS c, l_suppkey % 4 AS t, CASE WHEN l_partkey % 9 <> 0 THEN [l_partkey % 5, (l_partkey + 2) % 4] ELSE [] END AS p FROM lineitem), o AS (SELECT c, unnest(p) AS bb FROM s WHERE t < 2), q AS (SELECT c, bb, count(*) AS n FROM o GROUP BY 1, 2),
             a AS (SELECT c, count(*) FILTER (bb < 4) AS covered, count(*) FILTER (n > 1) AS dup FROM q GROUP BY 1), b AS (SELECT c, CAST(sum(CASE WHEN list_contains(p, 4) THEN 1 ELSE 0 END) AS BIGINT) AS bad, bool_or(len(p) = 0 AND t < 2) AS loose, count(*) FILTER (t = 2) AS g, count(*) FILTER (t = 3) AS k FROM s GROUP BY 1),
             f AS (SELECT o_orderkey AS c, coalesce(bad, 0) AS invalid_refs, 4 - coalesce(covered, 0) AS missing_blocks, coalesce(dup, 0) AS duplicate_blocks, NOT coalesce(loose, false) AND coalesce(bad, 0) = 0 AS grounded, coalesce(g, 0) AS n_goto, coalesce(k, 0) AS n_break FROM orders LEFT JOIN a ON a.c = o_orderkey LEFT JOIN b ON b.c = o_orderkey)
        SELECT *, concat_ws(',', CASE WHEN invalid_refs > 0 THEN 'invalid_bb_ref' END, CASE WHEN missing_blocks > 0 THEN 'missing_bb_coverage' END, CASE WHEN duplicate_blocks > 0 THEN 'duplicate_primary_bb' END, CASE WHEN NOT grounded THEN 'slot_grounding_incomplete' END) AS fatal FROM f""",
    "label_diagnosis": """WITH r AS (SELECT l_orderkey AS sample, l_linenumber AS b, min(l_partkey) AS p, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2), x AS (SELECT *, (sample, b) IN (SELECT (sample, b - 1) FROM r WHERE k % 3 = 2) OR p % 6 = 0 AS e FROM r),
             c AS (SELECT sample, count(*) FILTER (k % 9 = 4) AS loop_headers, count(*) FILTER (k % 9 = 4 AND NOT e) AS false_loop_headers, count(*) FILTER (k % 9 <> 4 AND e) AS missed_loop_headers, count(*) FILTER (k % 9 = 4 AND NOT e AND p % 3 <> 0) AS unsupported_loop_headers,
                          count(*) FILTER (k % 9 = 7) AS switch_headers, count(*) FILTER (k % 9 = 7 AND p % 4 <> 0) AS unsupported_switch_headers FROM x GROUP BY 1)
        SELECT c.*, greatest(0, loop_headers - o_custkey % 3) AS loops_over_source, greatest(0, switch_headers - o_custkey % 2) AS switches_over_source FROM c JOIN orders ON o_orderkey = sample""",
    "readiness_labels": """WITH o AS (SELECT *, o_totalprice / 400000 AS x, o_orderpriority = '1-URGENT' AS u FROM orders),
             s AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (x > 0.01) = count(*) AS hard, count(*) FILTER (x > 1.1) = 0 AS clean, count(*) FILTER (x > 0.05) / count(*) AS ssa, round(avg(0.88 + x / 5), 6) AS gr, count(*) FILTER (x > 0.2) / count(*) AS safe, count(*) FILTER (x > 0.1) / count(*) AS pool,
                          count(*) FILTER (x > 0.15) / count(*) AS ready, count(*) FILTER (x > 0.9) / count(*) AS fb, round(avg(o_custkey % 3), 6) AS gt, round(avg(x + 0.6), 6) AS cov, count(*) FILTER (u) AS sn, coalesce(count(*) FILTER (u AND x > 0.4) / nullif(count(*) FILTER (u), 0), 1) AS sw,
                          count(*) FILTER (x > 0.5) AS ln, coalesce(count(*) FILTER (x > 0.7) / nullif(count(*) FILTER (x > 0.5), 0), 1) AS la FROM o GROUP BY 1),
             r AS (SELECT *, list_filter([CASE WHEN NOT hard THEN 'hard_contract' END, CASE WHEN NOT clean THEN 'false_verified' END, CASE WHEN ssa < 0.95 THEN 'ssa_coverage' END, CASE WHEN gr < 0.9 THEN 'condition_grounding' END,
                   CASE WHEN safe < 0.5 THEN 'safe_selected' END, CASE WHEN pool < 0.5 THEN 'safe_pool' END, CASE WHEN ready < 0.6 THEN 'decompile_ready' END, CASE WHEN fb > 0.1 THEN 'fallback_regions' END,
                   CASE WHEN gt > 1 THEN 'gotos' END, CASE WHEN cov < 0.8 THEN 'structured_coverage' END, CASE WHEN sn > 0 AND sw < 0.5 THEN 'switches' END, CASE WHEN ln > 0 AND la < 0.5 THEN 'large_functions' END], lambda v: v IS NOT NULL) AS w FROM s)
        SELECT o_custkey, CASE WHEN NOT (hard AND clean AND ssa >= 0.95 AND gr >= 0.9) THEN 'B_NOT_READY' WHEN safe >= 0.7 AND pool >= 0.8 AND ready >= 0.7 AND fb <= 0.1 AND gt <= 1 AND cov >= 0.8 AND sw >= 0.5 AND la >= 0.5 THEN 'B_READY_FOR_FULL_CD' WHEN pool >= 0.15 AND ready >= 0.4 THEN 'B_READY_FOR_LIMITED_CD' ELSE 'B_SAFE_ONLY' END AS label,
               len(w) AS n_reasons, coalesce(w[1], '') AS first_reason FROM r""",
    "token_file_audit": """WITH r AS (SELECT max(l_linestatus) AS file, min(l_suppkey) % 8 AS k, count(*) FILTER (l_returnflag <> 'A') > 0 AND coalesce(max(l_partkey) FILTER (l_returnflag <> 'A'), 0) < 1900 AS ok FROM lineitem GROUP BY l_orderkey)
        SELECT file, count(*) AS n, count(*) FILTER (k IN (0, 1)) AS src_readable, count(*) FILTER (k = 2) AS src_weak_fallback, count(*) FILTER (k = 3) AS src_no_src, count(*) FILTER (k = 4) AS src_unresolvable, count(*) FILTER (k = 5) AS src_empty_file, count(*) FILTER (k > 5) AS src_other,
               count(*) FILTER (ok) AS ids_ok, count(*) FILTER (NOT ok) AS ids_bad, count(*) FILTER (ok AND k IN (0, 1)) AS both_ok FROM r GROUP BY 1""",
    "quality_components": f"""WITH f AS (SELECT p_partkey, p_size, {_RATES}, {_COUNTS}, {_HOLDS}, (p_partkey % 4) / greatest(1, p_partkey % 12) AS fb, greatest(1, p_partkey % 12) AS nb, p_partkey % 5 <> 0 AS hv FROM part),
             e AS (SELECT *, goto_count + break_count + continue_count + early_exit_count + cleanup_exit_count AS esc, slot_pointer_acc >= 0.98 AND branch_header_cond_slot_coverage >= 0.9 AND branch_provenance_coverage >= 0.9 AND condition_slot_grounded_rate >= 0.9 AS gr,
                   structured_bb_ratio >= 0.6 AND fb <= 0.3 AS st, slot_locality_score >= 0.98 AND empty_control_with_context_count = 0 AND body_bb_outside_control_count = 0 AS lo FROM f)
        SELECT p_partkey, round(CASE WHEN hv THEN 1000 - 24 * fb - 0.35 * p_size / nb + {_GOOD} ELSE -1000 - 20 * edge_uncovered_ratio - 5 * fb + 0.5 * (valid::INT + bb_coverage_ok::INT + edge_preservation_ok::INT) END, 6) AS rank_quality, round(fb, 6) AS fallback_ratio, CAST(esc AS BIGINT) AS escape_count,
               hv AND fb <= 0.3 AND goto_count <= 2 AND esc <= 4 AS cost_feasible, gr AS grounding_ready, st AS structured_ready, lo AS locality_ready, hv AND st AND gr AND lo AND goto_count <= 2 AND esc <= 4 AS doc_ready FROM e""",
    "structural_targets": """WITH a AS (SELECT p_partkey AS k, p_size / 50 AS x, least(1, p_size / 50 + 0.2) AS o, least(1, p_size / 50 + 0.3) AS q, p_partkey % 4 AS g, p_partkey % 3 = 0 AS av, p_partkey % 10 <> 0 AS hv, p_partkey % 7 <> 0 AS doc FROM part),
             b AS (SELECT *, o >= 0.999 AND g = 0 AS eo, q >= 0.999 AS ek, 0.46 * o + 0.34 * q + 0.14 * greatest(0, 1 - least(1, g / 3)) + CASE WHEN o >= 0.999 AND g = 0 THEN 0.04 ELSE 0 END + CASE WHEN q >= 0.999 THEN 0.02 ELSE 0 END AS ast FROM a),
             c AS (SELECT *, greatest(0, least(1, CASE WHEN av THEN 0.54 * ast + 0.22 * x + 0.14 * o + 0.1 * x ELSE ast END - 0.1 * least(1, x / 3) - 0.03 * least(1, (k % 3) / 3) - 0.02 * least(1, (k % 5) / 5))) AS s, hv AND doc AND CASE WHEN av THEN x >= 0.68 AND o >= 0.75 ELSE o >= 0.8 AND q >= 0.8 AND g <= 1 END AS soft FROM b),
             d AS (SELECT *, CASE WHEN NOT hv THEN 0 WHEN doc AND s >= 0.74 AND (o >= 0.78 OR q >= 0.86 OR eo OR ek) AND x / 3 <= 0.2 THEN 6 WHEN doc AND (soft OR s >= 0.62 AND (o >= 0.64 OR q >= 0.74) AND x / 3 <= 0.3) THEN 5 WHEN soft THEN 4 WHEN doc THEN 3 WHEN k % 2 = 0 THEN 2 ELSE 1 END AS t FROM c)
        SELECT k AS p_partkey, CASE WHEN hv THEN round(s, 6) ELSE 0 END AS score, CAST(t AS INTEGER) AS tier, ['invalid_not_trainable', 'strict_valid_low_confidence', 'binary_cost_feasible_only', 'binary_doc_quality_only', 'low_margin_structural_source_like', 'medium_confidence_structural_source_like', 'high_confidence_structural_source_like'][t + 1] AS status,
               t >= 5 AS trainable, CASE WHEN t >= 6 THEN 'high' WHEN t >= 5 THEN 'medium' WHEN t < 4 THEN 'low' ELSE 'low_margin' END AS confidence, hv AND (eo OR ek) AS exact, hv AND (soft OR t >= 5) AS soft,
               round(CASE WHEN hv THEN 10000 * t + 3 + 44 * round(s, 6) + 18 * round(ast, 6) + 10 * x + 8 * x + CASE WHEN eo OR ek THEN 4 ELSE 0 END + 4 * x + 3 * o + 2 * x - 6 * x / 4 - 4 * x / 8 ELSE 3 END, 4) AS quality FROM d""",
    "audit_tasks": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, 'fill ' || l_suppkey AS text FROM lineitem)
        SELECT l_orderkey, l_linenumber, 'task_' || substr(sha256(l_orderkey || '|' || l_partkey || '|' || text), 1, 16) AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, text) AS candidate_rank, text AS target_text, 'unreviewed' AS verdict FROM l""",
    "rendered_skeletons": """WITH c AS (SELECT l_orderkey AS f, l_linenumber % 2 + 1 AS s, arg_max(['x > 1', 'y = 2', 'z;', '{ }', '/* c */'][l_partkey % 6 + 1], (l_suppkey % 3, l_discount, l_partkey || '.' || l_suppkey)) FILTER (l_partkey % 6 < 5) AS x FROM lineitem GROUP BY 1, 2),
             k AS (SELECT o_orderkey AS f, o_custkey % 9 <> 0 AS has, o_custkey % 4 = 0 AS third, o_orderstatus AS st, a.x AS a, b.x AS b, a.s IS NOT NULL AND a.x IS NULL AS ha, b.s IS NOT NULL AND b.x IS NULL AS hb FROM orders LEFT JOIN c a ON a.f = o_orderkey AND a.s = 1 LEFT JOIN c b ON b.f = o_orderkey AND b.s = 2),
             m AS (SELECT *, CASE WHEN has THEN (a IS NULL)::INT + (b IS NULL)::INT + third::INT + ha::INT + hb::INT ELSE 0 END AS n FROM k)
        SELECT f, CASE WHEN has THEN 'if (' || coalesce(a, '<FILL_COND:slot_1>') || ') { ' || coalesce(CASE WHEN b = '/* c */' OR b NOT IN ('z;', '{ }') THEN b || ';' ELSE b END, '<FILL_STMT:slot_2> ;') || ' } /* ' || st || ' */' || CASE WHEN third THEN '<FILL_STMT:slot_3>' ELSE '' END END AS rendered, has AND n = 0 AS ok, CAST(n AS BIGINT) AS n_missing FROM m""",
    "matched_slots": f"WITH {_SLOTS} SELECT * FROM m",
    "slot_audit": f"""WITH {_SLOTS}, u AS (SELECT f, count(*) AS n_matched, count(*) FILTER (method = 'cond_order') AS n_by_order, round(avg(score), 4) AS mean_score FROM m GROUP BY 1)
        SELECT z.f, count(*) FILTER (p) AS n_predicted, count(*) FILTER (NOT p) AS n_wanted, coalesce(n_matched, 0) AS n_matched, coalesce(n_by_order, 0) AS n_by_order, mean_score,
               (SELECT count(*) FROM x WHERE x.f = z.f AND x.p) - coalesce(n_matched, 0) AS n_left, (SELECT count(*) FROM x WHERE x.f = z.f AND NOT x.p) - coalesce(n_matched, 0) AS n_open,
               (SELECT count(*) FROM b WHERE b.f = z.f AND score - second < 0.2) AS n_ambiguous
        FROM z LEFT JOIN u USING (f) GROUP BY z.f, n_matched, n_by_order, mean_score""",
    "injected_candidates": f"WITH {_INJECT} SELECT f, slot, 'srcproj_' || substr(sha256(f || '|' || slot || '|' || text), 1, 14) AS candidate_id, text FROM r WHERE reason = 'injected'",
    "injection_reasons": f"WITH {_INJECT} SELECT reason, count(*) AS n FROM r GROUP BY 1",
    "proxy_blocks": """WITH r AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS b, min(l_partkey) AS first, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2), e AS (SELECT sample, b AS src, b + j AS dst FROM r, range(1, 3) t(j) WHERE j <= k % 3)
        SELECT sample, b, first AS start, first + k % 9 AS stop, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM e WHERE e.sample = r.sample AND dst = b), '') AS predecessors, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM e WHERE e.sample = r.sample AND src = b), '') AS successors,
               ['return', 'jump', 'cond_branch'][k % 3 + 1] AS terminator, k % 3 = 0 AS has_return FROM r""",
    "parser_metrics": """WITH n AS (SELECT l_partkey AS k, l_suppkey AS s FROM lineitem), o AS (SELECT l_orderkey AS g, l_linenumber AS n, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
             x AS (SELECT g, n, CASE WHEN n <= 2 THEN k % 2 + 1 ELSE 0 END AS t, CASE WHEN n <= CASE WHEN g % 3 = 0 THEN 3 ELSE 2 END THEN CASE WHEN k % 5 = 0 THEN 1 ELSE k % 2 + 1 END ELSE 0 END AS p FROM o),
             c AS (SELECT g, count(*) FILTER (t <> 0) AS a, count(*) FILTER (p <> 0) AS b FROM x GROUP BY 1), w AS (SELECT c.g, a = b AS same, a = b AND NOT EXISTS (SELECT 1 FROM x WHERE x.g = c.g AND n <= a AND t <> p) AS whole FROM c)
        SELECT round(avg((k % 4 = s % 4)::INT), 6) AS control, round(avg((k % 4 = s % 4)::INT) FILTER (k % 4 = 1), 6) AS if_recall, round(avg((k % 4 = s % 4)::INT) FILTER (k % 4 = 2), 6) AS loop_recall, round(avg((k % 4 = s % 4)::INT) FILTER (k % 4 = 3), 6) AS switch_recall,
               round(avg((k % 3 = s % 3)::INT) FILTER (k % 6 <> 0), 6) AS role, round(avg((k % 2 = s % 2)::INT) FILTER (k % 6 <> 0), 6) AS slot, (SELECT round(avg((t = p)::INT) FILTER (t <> 0), 6) FROM x) AS outline_kind, (SELECT round(avg(same::INT), 6) FROM w) AS outline_count, (SELECT round(avg(whole::INT), 6) FROM w) AS outline_sequence FROM n""",
    "report_rows": "WITH c AS (SELECT o_orderstatus AS section, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY section ORDER BY '  ' || priority || ': ' || n || ' rows') + 1 AS line_no FROM c",
}

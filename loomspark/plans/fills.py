"""Fills of slots and their static check; contracts and outcomes are worked out by hand, and orders take turns with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import fills as L

from .tables import read

# Contracts by name: kind, allowed, forbidden, data_state, effect_state, condition, aliases, true_to, false_to, target, inverted.
CONTRACTS = {
    "cond": ("COND", "none", "", "nonempty_real", "nonempty_real", "cmp_0", "x,arg_0", 3, 4, None, False),
    "cond turned": ("COND", "none", "", "nonempty_real", "nonempty_real", "cmp_0", "x", 3, 4, None, True),
    "cond bare": ("COND", "", "", "not_available", "not_available", None, "", None, None, None, False),
    "cond no names": ("COND", "", "", "nonempty_real", "proven_empty_real", "cmp_1", "", 1, 2, None, False),
    "break": ("BREAK", "break", "", "not_available", "not_available", None, "", None, None, 7, False),
    "break lost": ("BREAK", "break", "", "not_available", "not_available", None, "", None, None, None, False),
    "continue": ("CONTINUE", "continue", "", "not_available", "not_available", None, "", None, None, 2, False),
    "goto": ("GOTO", "goto_like_internal", "", "not_available", "not_available", None, "", None, None, 12, False),
    "exit": ("EARLY_EXIT", "return", "", "nonempty_real", "nonempty_real", None, "", None, None, None, False),
    "cleanup": ("CLEANUP_EXIT", "goto_like_internal", "", "nonempty_real", "empty_proxy_needs_v3", None, "", None, None, 5, False),
    "block": ("BLOCK", "none", "return,goto", "nonempty_real", "nonempty_real", None, "", None, None, None, False),
    "block empty": ("BLOCK", "none", "return", "proven_empty_real", "proven_empty_real", None, "", None, None, None, False),
    "block open": ("BLOCK", "none", "", "empty_proxy_needs_v3", "not_available", None, "", None, None, None, False),
    "stmt": ("STMT", "none", "", "not_available", "not_available", None, "", None, None, None, False),
    "odd": ("REGION", "", "", "nonempty_real", "nonempty_real", None, "", None, None, None, False),
}
# Contract, fill, errors, warnings.
CASES = [
    ("cond", "x > 0", "", ""),
    ("cond", "arg_0 == NULL", "", ""),
    ("cond", "y > 0", "", "condition_unproven"),
    ("cond", "p->x > 0", "", "condition_unproven"),
    ("cond", "x(1)", "", "condition_unproven"),
    ("cond", "(int) x /* y */", "", ""),
    ("cond", "ECSL_UNKNOWN", "unknown_text", "condition_unproven"),
    ("cond turned", "!x", "", "polarity"),
    ("cond bare", "x", "", "condition_missing,ways_missing"),
    ("cond no names", "a && b", "", "names_unmapped"),
    ("cond no names", "a = b", "effects_against_empty_contract", "names_unmapped"),
    ("cond no names", "a == b", "", "names_unmapped"),
    ("cond no names", "f(a)", "effects_against_empty_contract", "names_unmapped"),
    ("cond no names", "i++ < 3", "effects_against_empty_contract", "names_unmapped"),
    ("break", "break;", "", ""),
    ("break", "continue;", "wrong_transfer", ""),
    ("break", "", "wrong_transfer", ""),
    ("break", "breaker;", "wrong_transfer", ""),
    ("break lost", "break", "", "target_missing"),
    ("continue", "continue;", "", ""),
    ("continue", "break;", "wrong_transfer", ""),
    ("goto", "goto label_12;", "", ""),
    ("goto", "goto label_BB_12;", "", ""),
    ("goto", "goto label_1;", "wrong_label", ""),
    ("goto", "label_12;", "wrong_transfer,wrong_label", ""),
    ("goto", "goto label_UNKNOWN;", "unknown_text,wrong_label", ""),
    ("exit", "return x;", "", ""),
    ("exit", "x = 1;", "wrong_transfer", ""),
    ("exit", "return ECSL_EARLY_EXIT_VALUE;", "unknown_text", ""),
    ("cleanup", "goto cleanup_all;", "", "effects_unproven"),
    ("cleanup", "goto label_5;", "", "effects_unproven"),
    ("cleanup", "goto out;", "wrong_label", "effects_unproven"),
    ("block", "x = y + 1;", "", ""),
    ("block", "return x;", "forbidden_transfer", ""),
    ("block", "if (x) goto out;", "forbidden_transfer", ""),
    ("block", "/* return */ x = 1;", "", ""),
    ("block", 's = "goto";', "", ""),
    ("block", "rax_3 = rbx_1;", "register_move", ""),
    ("block", "rax_3 = rbx_1 + 1;", "", ""),
    ("block", "eax_1 = tmp;", "", ""),
    ("block", ";", "", "empty_unproven"),
    ("block empty", ";", "", ""),
    ("block empty", "x;", "names_against_empty_data", ""),
    ("block empty", "x += 1;", "names_against_empty_data,effects_against_empty_contract", ""),
    ("block empty", "f(1);", "effects_against_empty_contract", ""),
    ("block empty", "ECSL_effect_probe(1);", "", "probe"),
    ("block empty", "ECSL_dataflow_probe(x);", "", "probe"),
    ("block empty", "return;", "effects_against_empty_contract,forbidden_transfer", ""),
    ("block empty", "1;", "", ""),
    ("block open", "x = 1;", "", "data_unproven,effects_unproven"),
    ("block open", "/* ECSL_BINARY_BLOCK */", "unknown_text", "data_unproven,effects_unproven,empty_unproven"),
    ("stmt", "return x;", "", ""),
    ("stmt", "goto out;", "", ""),
    ("stmt", "x = 2;", "", "data_unproven,effects_unproven"),
    ("odd", "x = 2;", "unsupported", ""),
]


def fill_checks(spark: SparkSession, d: str) -> DataFrame:
    arrays = lambda s: [x for x in s.split(",") if x]
    rows = []
    for k, (name, text, _, _) in enumerate(CASES):
        c = CONTRACTS[name]
        rows.append((k, text, c[0], arrays(c[1]), arrays(c[2]), *c[3:6], arrays(c[6]), *c[7:]))
    schema = "k int, text string, kind string, allowed array<string>, forbidden array<string>, data_state string, effect_state string, condition string, aliases array<string>, true_to int, false_to int, target int, inverted boolean"
    cases = F.broadcast(spark.createDataFrame(rows, schema))
    fills = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % len(CASES)).cast("int").alias("k")).join(cases, "k").drop("k")
    return L.static_check(fills, ["o_orderkey"], "text").select("o_orderkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "status")


QUERIES = {"fill_checks": fill_checks}
_ROWS = ", ".join(f"({k}, '{e}', '{w}')" for k, (_, _, e, w) in enumerate(CASES))
ORACLES = {
    "fill_checks": f"WITH t(k, errors, warnings) AS (VALUES {_ROWS}) SELECT o_orderkey, errors, warnings, CASE WHEN errors <> '' THEN 'fail' WHEN warnings <> '' THEN 'partial_needs_v3' ELSE 'pass' END AS status FROM orders JOIN t ON k = o_orderkey % {len(CASES)}",
}

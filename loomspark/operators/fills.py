"""Static check of fills: what a text that fills a slot does, read off its tokens, against what the slot's contract allows.

Facts of all fills come from one token table; rules are conditions on them and on the contract, each with a code. An error contradicts the contract; a warning says what only a run can prove. A fill
without errors and warnings is a `pass`, one with warnings alone `partial_needs_v3`, others `fail`.

Cases: a null or empty fill has no tokens and does nothing. Comments count for nothing, but that marks of unknown text are found in them, too. A null list of a contract is empty; a kind in other letters or unknown is `unsupported`. `key` must name a fill. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.ctokens import TAGS, TYPE_WORDS, WORDS, tokens

# Marks of text that is no fill yet, beginnings of probes, names of registers in single-assignment form, operators that assign, and words that leave a place.
UNKNOWN = "ECSL_UNKNOWN|ECSL_BINARY_BLOCK|ECSL_EARLY_EXIT_VALUE|label_UNKNOWN"
PROBES = ["ECSL_dataflow_probe", "ECSL_effect_probe"]
REGISTER = r"^(?:r(?:[abcd]x|[sd]i|[sb]p|[0-9]+[bwd]?|ip|flags)|e(?:[abcd]x|[sd]i|[sb]p|ip|flags)|[abcd][lh]|[er]?flags|[a-z]{1,3})_[0-9]+$"
ASSIGNS = ["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "++", "--"]
LEAVES = ["return", "break", "continue", "goto"]
#: Kinds of slots that transfer control: the word that a fill begins with, and the effect that the contract must allow.
TRANSFERS = {"BREAK": ("break", "break"), "CONTINUE": ("continue", "continue"), "GOTO": ("goto", "goto_like_internal"), "EARLY_EXIT": ("return", "return"), "CLEANUP_EXIT": ("goto", "goto_like_internal")}
PLAIN = ["BLOCK", "CASE_LABEL", "STMT", "EXPR", "LVALUE", "CALL_ARG", "CALL_TARGET", "RETURN", "EXIT", "LOOP_EXIT"]
#: States of facts that count as known (dataflow.fact_state).
KNOWN = ["nonempty_real", "nonempty_proxy", "proven_empty_real"]


def fill_facts(fills: DataFrame, key: list[str], text: str) -> DataFrame:
    """key with names (locals and globals that are read or written, sorted), n_calls, n_assigns, leaves (words that transfer control), head (first token), label (behind goto), n (tokens but semicolons), probe, unknown
    and register_move (one register's name is assigned to another's)."""
    w = Window.partitionBy(*key).orderBy("pos")
    rows = tokens(fills, key, text).where("kind IS NULL OR kind <> 'comment'").withColumns({"before": F.lag("token").over(w), "next": F.lead("token").over(w)})
    name = (F.col("kind") == "name") & ~F.col("token").isin(*TYPE_WORDS, *TAGS, *WORDS)
    field = F.coalesce(F.col("before").isin(".", "->", *TAGS), F.lit(False))
    call, target = F.coalesce(F.col("next") == "(", F.lit(False)), F.coalesce(F.col("before") == "goto", F.lit(False))
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("token"))))
    in_order = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull() & (F.col("token") != ";"), F.struct("pos", "token"))))
    found = rows.groupBy(*key).agg(
        some(name & ~field & ~call & ~target).alias("names"), F.count_if(name & call).alias("n_calls"), F.count_if(F.col("token").isin(ASSIGNS)).alias("n_assigns"), some(F.col("token").isin(LEAVES)).alias("leaves"),
        F.min_by("token", "pos").alias("head"), F.max(F.when(target, F.col("token"))).alias("label"), in_order.alias("_t"),
    )
    t = F.transform("_t", lambda x: x["token"])
    found = found.withColumn("_t", t).withColumns({"n": F.size("_t"), "probe": F.coalesce(F.col("head").isin(PROBES), F.lit(False))})
    move = (F.col("n") == 3) & (F.get("_t", F.lit(1)) == "=") & F.get("_t", F.lit(0)).rlike(REGISTER) & F.get("_t", F.lit(2)).rlike(REGISTER)
    found = found.withColumn("register_move", F.coalesce(move, F.lit(False))).drop("_t")
    # fills of comments alone have lost all their rows
    out = fills.select(*key, F.col(text).rlike(UNKNOWN).alias("unknown")).join(found, key, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("names", "leaves")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_calls", "n_assigns", "n")} | {c: F.coalesce(c, F.lit(False)) for c in ("probe", "unknown", "register_move")})


def _codes(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())


def static_check(fills: DataFrame, key: list[str], text: str, full: bool = False) -> DataFrame:
    """key with errors, warnings and status of fills that carry their slot's contract: kind, allowed and forbidden (arrays of effects), data_state, effect_state, condition, aliases (array of names that may stand for it), true_to,
    false_to and target (blocks), inverted (whether the branch was turned). With `full` what is missing of a condition's or a block's facts is an error, too."""
    rows = fills.join(fill_facts(fills.select(*key, text), key, text), key)
    kind, none = F.col("kind"), F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    allowed, aliases, names, leaves = listed("allowed"), listed("aliases"), F.col("names"), F.col("leaves")
    condition, transfer = kind == "COND", kind.isin(list(TRANSFERS))
    block = kind.isin(PLAIN)
    words, effects = (F.create_map(*[F.lit(x) for k, v in TRANSFERS.items() for x in (k, v[i])]) for i in (0, 1))
    proven = lambda c: F.col(c) == "proven_empty_real"
    known = lambda c: F.coalesce(F.col(c).isin(KNOWN), F.lit(False))
    labels = F.array(F.concat(F.lit("label_"), F.col("target").cast("string")), F.concat(F.lit("label_BB_"), F.col("target").cast("string")))
    at_label = F.coalesce(F.array_contains(labels, F.col("label")), F.lit(False))
    simple = (kind == "STMT") & F.coalesce(F.col("head").isin(LEAVES), F.lit(False))
    needs_facts = block & ~simple
    exits = kind.isin("EARLY_EXIT", "CLEANUP_EXIT")
    ways = F.col("true_to").isNotNull() & F.col("false_to").isNotNull()
    must = F.lit(full)
    errors = {
        "unknown_text": F.col("unknown"),
        "names_against_empty_data": proven("data_state") & ~F.col("probe") & (F.size(names) > 0),
        "effects_against_empty_contract": proven("effect_state") & ((F.col("n_assigns") > 0) | ((F.col("n_calls") > 0) & ~F.col("probe")) | ((F.size(leaves) > 0) & (F.size(F.array_remove(allowed, "none")) == 0))),
        "no_condition": condition & must & F.col("condition").isNull(),
        "no_ways": condition & must & ~ways,
        "wrong_transfer": transfer & ~(F.coalesce(F.col("head") == words[kind], F.lit(False)) & F.array_contains(allowed, effects[kind])),
        "wrong_label": ((kind == "GOTO") & F.col("target").isNotNull() & ~at_label) | ((kind == "CLEANUP_EXIT") & ~at_label & ~F.coalesce(F.contains("label", F.lit("cleanup")), F.lit(False))),
        "no_target": must & kind.isin("BREAK", "CONTINUE", "GOTO") & F.col("target").isNull(),
        "register_move": block & F.col("register_move"),
        "forbidden_transfer": block & F.arrays_overlap(leaves, listed("forbidden")),
        "no_facts": must & (needs_facts | exits) & ~(known("data_state") & known("effect_state")),
        "unsupported": ~F.coalesce(condition | transfer | block, F.lit(False)),
    }
    warnings = {
        "condition_missing": condition & F.col("condition").isNull(),
        "condition_unproven": condition & F.col("condition").isNotNull() & (F.size(aliases) > 0) & ~F.arrays_overlap(names, aliases),
        "names_unmapped": condition & F.col("condition").isNotNull() & (F.size(aliases) == 0),
        "ways_missing": condition & ~ways,
        "polarity": condition & F.col("inverted"),
        "target_missing": kind.isin("BREAK", "CONTINUE", "GOTO") & F.col("target").isNull(),
        "data_unproven": (needs_facts | exits) & ~known("data_state"),
        "effects_unproven": (needs_facts | exits) & ~known("effect_state"),
        "empty_unproven": block & (F.col("n") == 0) & ~F.coalesce(proven("effect_state"), F.lit(False)),
        "probe": block & F.col("probe"),
    }
    out = rows.select(*key, _codes(errors).alias("errors"), _codes(warnings).alias("warnings"))
    # fixed values: the three outcomes
    return out.withColumn("status", F.when(F.size("errors") > 0, "fail").when(F.size("warnings") > 0, "partial_needs_v3").otherwise("pass"))

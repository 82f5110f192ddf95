"""Token tables of C statements: canonical forms, renamed forms, and proofs that two statements are the same.

A statement is split once into typed tokens, a row each; what follows are windows and filters over the tokens of all statements at once. Parentheses are paired by depth
counters: at one level an opening one's partner is the next one. Comments and closing semicolons go; casts are pairs that hold words of types, stars and tags alone and do not follow
a name; superfluous pairs hold one name or number, or all of the statement (behind `return`, or within the condition of an `if` or `while`). Integer suffixes go and common
constants become numbers. The renamed form numbers names in the order of their first use, but for keywords, calls, tags, fields behind `.` or `->` and names in capitals.

Cases: a null or empty statement has no tokens and empty forms. What is in a string or character literal is one token, whatever it holds. Unbalanced parentheses stay. Statements of any length are
sorted by place, not held as one value; repeated keys are told apart by no one, so `key` must name a row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.spread import parts, spread

#: Characters of statements, and those that a row counts for itself, in one task.
EACH, ROW = 400_000, 16

# Constants and what they stand for; words of types and tags, and other words of the language.
CONSTANTS = {"NULL": "0", "true": "1", "false": "0", "TRUE": "1", "FALSE": "0", "EXIT_SUCCESS": "0", "EXIT_FAILURE": "1"}
TYPE_WORDS = ["_Bool", "bool", "char", "const", "double", "float", "int", "int8_t", "int16_t", "int32_t", "int64_t", "long", "short", "signed", "size_t", "ssize_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "uintptr_t", "unsigned", "void", "volatile"]
TAGS = ["enum", "struct", "union"]
WORDS = ["break", "case", "continue", "default", "do", "else", "for", "goto", "if", "return", "sizeof", "static", "switch", "while"]

#: Kinds of tokens, in the order in which they are tried.
KINDS = {
    "comment": r"/\*(?:[^*]|\*(?!/))*+(?:\*/)?|//[^\n]*+",
    "string": r'"(?:\\.|[^"\\])*+"?|' + r"'(?:\\.|[^'\\])*+'?",
    "number": r"\.?[0-9](?:[eEpP][+-]|[A-Za-z0-9_.])*+",
    "name": r"[A-Za-z_][A-Za-z0-9_]*+",
    "operator": r"->|\+\+|--|<<=|>>=|<<|>>|&&|\|\||[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~?:.,;()\[\]{}]",
    "other": r"[^\s]",
}


def tokens(statements: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, pos (from 0), token and kind; a statement without tokens has one row of nulls."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)" + "|".join(KINDS.values())), F.lit(0))
    rows = statements.select(*key, F.posexplode_outer(found).alias("pos", "token"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(F.col("token").rlike(rf"(?s)\A(?:{pattern})\z"), name).otherwise(kind)
    return rows.withColumn("kind", kind)


def _counted(key: list[str]):
    return Window.partitionBy(*key).orderBy("pos")


def paired(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with `partner`, the place of the other parenthesis of a pair (null for other tokens and for parentheses without one)."""
    w = _counted(key)
    is_open, is_close = F.col("token") == "(", F.col("token") == ")"
    depth = F.sum(F.when(is_open, 1).when(is_close, -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", F.when(is_open, depth).when(is_close, depth + 1))
    at = Window.partitionBy(*key, "level").orderBy("pos")
    after, before = F.lead("token").over(at), F.lag("token").over(at)
    partner = F.when(is_open & (after == ")"), F.lead("pos").over(at)).when(is_close & (before == "("), F.lag("pos").over(at))
    return rows.withColumn("partner", F.when(F.col("level").isNotNull(), partner)).drop("level")


def _counts(key: list[str], what: Column) -> Column:
    """How many tokens up to this one `what` holds for."""
    return F.sum(F.when(what, 1).otherwise(0)).over(_counted(key).rowsBetween(Window.unboundedPreceding, 0))


def _renumbered(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(_counted(key)) - 1)


def _at_partner(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Bring columns of an opening parenthesis' partner to it, as other_<name>; both stand beside each other when ordered by the earlier place of the pair."""
    pair = Window.partitionBy(*key, F.least("pos", F.coalesce("partner", "pos"))).orderBy("pos")
    return rows.withColumns({f"other_{c}": F.lead(c).over(pair) for c in columns})


def _without(rows: DataFrame, key: list[str], gone: Column, whole: bool) -> DataFrame:
    """rows without the pairs whose opening parenthesis `gone` holds for, and if `whole` without what is between."""
    pair = Window.partitionBy(*key, F.least("pos", F.coalesce("partner", "pos")))
    rows = rows.withColumn("_gone", F.coalesce(F.max(F.coalesce(gone, F.lit(False)) & (F.col("token") == "(")).over(pair), F.lit(False)))
    if whole:
        step = F.when(~F.col("_gone"), 0).when(F.col("token") == "(", 1).otherwise(-1)
        inside = F.sum(step).over(_counted(key).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_gone", F.col("_gone") | (inside > 0))
    return _renumbered(rows.where("NOT _gone").drop("_gone", "partner"), key)


def simplified(rows: DataFrame, key: list[str]) -> DataFrame:
    """Tokens of statements without comments, closing semicolons, casts and superfluous parentheses; constants and integers in their plain form."""
    w = _counted(key)
    rows = rows.where("kind IS NULL OR kind <> 'comment'")
    behind = Window.partitionBy(*key).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    closing = F.max(F.col("token") != ";").over(behind)  # whether anything but semicolons is left from here on
    rows = _renumbered(rows.withColumn("_open", closing).where("_open OR token IS NULL").drop("_open"), key)

    # casts
    name = F.col("kind") == "name"
    rows = rows.withColumns({"before": F.lag("token").over(w), "kind_before": F.lag("kind").over(w), "next": F.lead("token").over(w)})
    typed = F.coalesce(F.col("token").isin(*TYPE_WORDS, *TAGS, "*") | (name & F.col("before").isin(*TAGS)), F.lit(False))
    rows = paired(rows, key).withColumns({"odd": _counts(key, ~typed), "behind": F.lead("token").over(w), "behind_kind": F.lead("kind").over(w)})
    rows = _at_partner(rows, key, ["odd", "pos", "behind", "behind_kind"])
    operand = F.col("other_behind_kind").isin("name", "number", "string") | F.col("other_behind").isin("(", "-", "+", "!", "~", "*", "&", "++", "--")
    called = (F.col("kind_before") == "name") & (F.col("before") != "return")
    cast = (F.col("other_odd") - F.col("odd") == 1) & (F.col("other_pos") - F.col("pos") > 1) & (F.col("next") != "*") & operand & ~F.coalesce(called, F.lit(False))  # the closing one is odd itself
    rows = _without(rows, key, cast, True).select(*key, "pos", "token", "kind")

    # superfluous pairs
    rows = paired(rows, key).withColumns({"before": F.lag("token").over(w), "kind_before": F.lag("kind").over(w), "n": F.count("token").over(Window.partitionBy(*key)), "head": F.first("token").over(w), "second_ends": F.lead("partner").over(w)})
    rows = rows.withColumn("second_ends", F.first("second_ends").over(w))
    opened = F.col("token") == "("
    whole = F.col("head").isin("if", "while") & (F.col("second_ends") == F.col("n") - 1)
    rows = rows.withColumns(
        {
            "opens": _counts(key, opened),
            "plain": _counts(key, ~F.col("token").isin("(", ")")),
            "behind": F.lead("token").over(w),
            "behind_kind": F.lead("kind").over(w),
            "skip": F.when(F.col("head") == "return", 1).when(whole, 2).otherwise(0),
            "end": F.when(whole, F.col("n") - 1).otherwise(F.col("n")),
            "outside": F.when(whole, 1).otherwise(0),
        }
    )
    rows = _at_partner(rows.withColumn("run", F.when(opened, F.col("pos") - F.col("opens"))), key, ["plain", "pos"])
    run = Window.partitionBy(*key, "run")  # parentheses that open one behind the other
    rows = rows.withColumns({"within": F.max("pos").over(run) + 1 - F.col("pos"), "content": F.max(F.when(F.col("behind") != "(", F.col("behind_kind"))).over(run)})
    size = F.col("other_pos") - F.col("pos")
    follows = F.coalesce(F.col("kind_before").isin("name", "number", "string") & (F.col("before") != "return"), F.lit(False)) | F.coalesce(F.col("before").isin(")", "]"), F.lit(False))
    atom = (F.col("other_plain") - F.col("plain") == 1) & (size == 2 * F.col("within")) & F.col("content").isin("name", "number") & ~follows
    place = F.col("pos") - F.col("skip")
    wraps = (size > 1) & (place >= 0) & (2 * place + size == F.col("end") - F.col("skip") - 1) & (F.col("opens") - F.col("outside") == place + 1)
    rows = _without(rows, key, F.coalesce(atom, F.lit(False)) | F.coalesce(wraps, F.lit(False)), False).select(*key, "pos", "token", "kind")

    # plain forms of constants and integers
    field = F.coalesce(F.lag("token").over(w).isin(".", "->"), F.lit(False))
    constants = F.create_map(*[F.lit(x) for pair in CONSTANTS.items() for x in pair])
    constant = F.when(~field & (F.col("kind") == "name"), constants[F.col("token")])
    number = F.when(F.col("kind") == "number", F.regexp_replace("token", r"\A(0[xX][0-9A-Fa-f]+|[0-9]+)[uUlL]+\z", "$1"))
    return rows.withColumns({"token": F.coalesce(constant, number, "token"), "kind": F.when(constant.isNotNull(), "number").otherwise(F.col("kind"))})


def renamed(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with `local`, the number (from 0) of a local name in the order of first use, null for all else."""
    w = _counted(key)
    field, call = F.coalesce(F.lag("token").over(w).isin(".", "->", *TAGS), F.lit(False)), F.coalesce(F.lead("token").over(w) == "(", F.lit(False))
    fixed = F.col("token").isin(*TYPE_WORDS, *TAGS, *WORDS) | F.col("token").rlike("^[A-Z][A-Z0-9_]*$")
    rows = rows.withColumn("_name", F.when((F.col("kind") == "name") & ~fixed & ~field & ~call, F.col("token")))
    rows = rows.withColumn("_first", F.when(F.col("_name").isNotNull(), F.min("pos").over(Window.partitionBy(*key, "_name"))))
    return rows.withColumn("local", F.when(F.col("_name").isNotNull(), F.dense_rank().over(Window.partitionBy(*key).orderBy(F.col("_first").asc_nulls_last())) - 1)).drop("_name", "_first")


def _joined(piece: Column, before: Column) -> Column:
    """A token with a blank before it where it would run into the one before."""
    words = before.rlike("[A-Za-z0-9_]$") & piece.rlike("^[A-Za-z0-9_]")
    merged = (F.substring(before, -1, 1) == F.substring(piece, 1, 1)) & F.substring(piece, 1, 1).isin("+", "-", "&", "|", "<", ">")
    return F.concat(F.when(words | merged, " ").otherwise(""), piece)


def _dealt(statements: DataFrame, key: list[str], texts: list[str]) -> DataFrame:
    """statements in parts of about as many characters each, before they are split: a token's row is many times as large as its text."""
    weight = F.lit(ROW)
    for t in texts:
        weight = weight + F.coalesce(F.length(t), F.lit(0))
    return spread(statements.select(*key, *texts), key, parts(statements, EACH, weight))


def canonical_statements(statements: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, canonical (the text in its plain form), alpha (with local names as v0, v1, ...) and shaped (whether it has an operator or `return`)."""
    return _forms(_dealt(statements, key, [text]), key, text)


def _forms(statements: DataFrame, key: list[str], text: str) -> DataFrame:
    rows = renamed(simplified(tokens(statements, key, text), key), key)
    w = _counted(key)
    alpha = F.coalesce(F.concat(F.lit("v"), F.col("local").cast("string")), "token")
    rows = rows.withColumn("alpha", alpha).withColumns({"_c": F.coalesce(_joined(F.col("token"), F.lag("token").over(w)), "token"), "_a": F.coalesce(_joined(F.col("alpha"), F.lag("alpha").over(w)), "alpha")})
    each = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "_c", "_a"))))
    found = rows.groupBy(*key).agg(each.alias("_t"), F.coalesce(F.max((F.col("kind") == "operator") & ~F.col("token").isin(",", ";", "{", "}", "?", ":") | (F.col("token") == "return")), F.lit(False)).alias("shaped"))
    text_of = lambda c: F.array_join(F.transform("_t", lambda x: x[c]), "")
    whole = found.select(*key, text_of("_c").alias("canonical"), text_of("_a").alias("alpha"), "shaped")
    # statements of comments or semicolons alone have lost all their rows
    return statements.select(*key).join(whole, key, "left").select(*key, F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("alpha", F.lit("")).alias("alpha"), F.coalesce("shaped", F.lit(False)).alias("shaped"))


def symbolic_proofs(pairs: DataFrame, key: list[str], candidate: str, reference: str, allow_alpha: bool = False) -> DataFrame:
    """key and `proof`: how the two texts are equal, `canonical`, `alpha` (if allowed, and both have some structure) or `none`."""
    side = lambda c, k: F.struct(F.lit(k).alias("_side"), F.col(c).alias("_text"))
    # both texts of a pair stay in one part
    sides = _dealt(pairs, key, [candidate, reference]).select(*key, F.inline(F.array(side(candidate, 0), side(reference, 1))))
    both = _forms(sides, [*key, "_side"], "_text")
    of = lambda c, k: F.max(F.when(F.col("_side") == k, F.col(c)))
    two = both.groupBy(*key).agg(*(of(c, k).alias(f"{c}{k}") for c in ("canonical", "alpha", "shaped") for k in (0, 1)))
    alpha = F.lit(allow_alpha) & (F.col("canonical0") != "") & F.col("shaped0") & F.col("shaped1") & (F.col("alpha0") == F.col("alpha1"))
    return two.select(*key, F.when((F.col("canonical0") != "") & (F.col("canonical0") == F.col("canonical1")), "canonical").when(alpha, "alpha").otherwise("none").alias("proof"))

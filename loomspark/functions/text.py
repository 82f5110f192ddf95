"""String functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(c: Column) -> Column:
    """Trimmed, backslashes as slashes."""
    return F.replace(F.trim(c), F.lit("\\"), F.lit("/"))


def rewrite_prefixes(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered prefix rewrites, each applied to what the earlier ones left."""
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    for old, new in rules:
        c = F.when(F.startswith(c, F.lit(old)), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(c)
    return c


def project_after(c: Column, anchor: str, depth: int = 1) -> Column:
    """The `depth` path parts behind the first part equal to anchor (any case), joined by `/`; null without them."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    at = F.array_position(F.transform(parts, F.lower), anchor.lower())
    return F.when((at > 0) & (at + depth <= F.size(parts)), F.array_join(F.slice(parts, at.cast("int") + 1, depth), "/"))


# Optimisation levels in the order in which they are looked for.
OPT_LEVELS = ["o0", "o1", "o2", "o3", "os"]


def opt_level(*names: Column) -> Column:
    """The level in the first of several names or commands that has one: a word `o0` ... (the first level of the order wins), else a flag `-O2`; else `unknown`."""
    tried = []
    for name in names:
        low = F.lower(F.coalesce(name, F.lit("")))
        tried += [F.when(F.rlike(low, F.lit(f"(^|[^a-z0-9]){x}([^a-z0-9]|$)")), F.lit(x)) for x in OPT_LEVELS]
        flag = F.regexp_extract(low, r"-o([0123s])\b", 1)
        tried.append(F.when(flag != "", F.concat(F.lit("o"), flag)))
    return F.coalesce(*tried, F.lit("unknown"))


def strip_comments(c: Column) -> Column:
    """C comments become a space."""
    return F.regexp_replace(c, r"(?sm)/\*.*?\*/|//[^\n]*$", " ")


def is_control(c: Column) -> Column:
    """Whether a statement begins with a control keyword."""
    return F.rlike(F.trim(c), F.lit(r"^(if|else|for|while|do|switch|case|default|return|goto|break|continue)\b"))


def token_id(c: Column, vocabulary: int) -> Column:
    """1 + crc32 modulo (vocabulary - 1); 0 if the vocabulary has one id or none."""
    if vocabulary <= 1:
        return F.lit(0).cast("long")
    return 1 + F.pmod(F.crc32(F.encode(c, "UTF-8")), F.lit(vocabulary - 1))


def token_ids(c: Column, vocabulary: int) -> Column:
    """Ids of the words between white space; a statement without words has the one id 0."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.transform(words, lambda w: token_id(w, vocabulary))).otherwise(F.array(F.lit(0).cast("long")))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer length, 1 at least."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def brace_balance(c: Column, opening: str = "{", closing: str = "}") -> Column:
    """Opening less closing marks."""
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return count(opening) - count(closing)


def _balance(text: str | None) -> tuple[int, int, int]:
    """Opening less closing ( [ { outside of string and character literals."""
    count, quote, skip = {"(": 0, "[": 0, "{": 0}, "", False
    pair = {")": "(", "]": "[", "}": "{"}
    for ch in text or "":
        if skip or ch == "\\":
            skip = not skip
        elif quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in count:
            count[ch] += 1
        elif ch in pair:
            count[pair[ch]] -= 1
    return count["("], count["["], count["{"]


def delimiter_balance(c: Column) -> Column:
    """struct(paren, bracket, brace) of opening less closing marks outside of literals; a null text has none."""

    @F.pandas_udf("paren int, bracket int, brace int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_balance(t) for t in texts], columns=["paren", "bracket", "brace"])

    return run(c)


def slot_id(c: Column) -> Column:
    """`slot_7`, `slot_007` and `7` become `slot_007`; null without digits."""
    digits = F.regexp_extract(c, r"(\d+)\s*$", 1)
    n = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(digits != "", F.concat(F.lit("slot_"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)))


def json_fingerprint(*columns: Column, length: int = 64) -> Column:
    """Leading hex digits of the SHA-256 of the columns as JSON; for equality within Spark."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, length)


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether any needle (plain text, any case) occurs."""
    low = F.lower(c)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n.lower()))
    return out


def first_rule(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first (needle, name) whose needle occurs in the text."""
    out = F.lit(otherwise)
    for needle, name in reversed(rules):
        out = F.when(F.contains(F.lower(c), F.lit(needle)), F.lit(name)).otherwise(out)
    return out


# Other names of slot types.
SLOT_TYPES = {
    "FILL_COND": "COND", "COND_SLOT": "COND", "CONDITION": "COND", "SWITCH_DISPATCH": "COND", "FILL_STMT": "STMT", "STATEMENT": "STMT", "FILL_BLOCK": "BLOCK", "BLOCK_SLOT": "BLOCK", "UNSTRUCTURED_REGION": "BLOCK",
    "FILL_CASE": "CASE_LABEL", "CASE_SLOT": "CASE_LABEL", "CASE": "CASE_LABEL", "FILL_GOTO": "EXIT", "GOTO_SLOT": "EXIT", "GOTO": "EXIT", "FILL_CLEANUP_EXIT": "EXIT", "CLEANUP_EXIT_SLOT": "EXIT", "CLEANUP_EXIT": "EXIT",
    "FILL_BREAK": "LOOP_EXIT", "BREAK_SLOT": "LOOP_EXIT", "BREAK": "LOOP_EXIT", "FILL_CONTINUE": "LOOP_EXIT", "CONTINUE_SLOT": "LOOP_EXIT", "CONTINUE": "LOOP_EXIT", "LOOP_CONTINUE": "LOOP_EXIT",
    "FILL_EARLY_EXIT": "RETURN", "EARLY_EXIT_SLOT": "RETURN", "EARLY_EXIT": "RETURN",
}


def slot_type(c: Column) -> Column:
    """The type behind a name in any case; unknown names stay, in capitals."""
    raw = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in SLOT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, raw), raw)

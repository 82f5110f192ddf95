"""License scans: ordered signature rules behind a keyword gate, with priorities and interval containment.

A text's words, lower-cased and joined by one space, are searched for the rules of `license_signatures` whose keyword stands in them; texts without any
of the GATE stems, one of which every signature holds, are not even joined. A rule marks its matches in the joined text, so word positions follow from the
marked words in one pass. A detection inside another of the same or a higher priority is suppressed; of equal intervals the higher priority, then the
earlier rule stays. An interval has MAX_WORDS words at most, so in the order of their starts a detection is compared only with as many neighbours as start
within MAX_WORDS words anywhere in the text: that covers every overlap and stays linear in the length of a text.

Only DataFrame functions run here; a row is worked on in its own task, without a shuffle.

Cases: a null or empty text has no words and no detections. Repeated rows and null or repeated ids are scanned row by row. Texts of any length are searched whole. An empty table
gives an empty result. Extra columns pass through; this operator's own columns replace those of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_signatures import MAX_WORDS, SIGNATURES
from .shared import unused

#: Words before lower-casing: letters and digits of ASCII, and all else beyond it.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every signature's keyword or words hold one of these.
GATE = ["licen", "gpl", "copy", "warrant", "redistribut", "permission", "permitted", "domain", "apache", "bsd", "commons", "cc", "software", "attribution", "commercial", "research", "confidential", "wtf", "advertising", "written", "reserved",
        "odbl", "sspl", "rail", "cecill", "exception", "cddl", "eupl", "return", "cover", "mozilla", "executable", "clause", "just", "mulan", "agreement", "polyform", "terms", "good", "released", "distributed", "available", "published",
        "provided"]
#: A match is marked before its first and behind its last word; no word holds these.
OPEN, CLOSE = "\u0001", "\u0002"
#: Neighbours on either side that a detection is compared with: the first number that is enough for a text, else all.
REACH = [8, 32, 128, 512, 2048]

# Label, keyword, pattern of the base phrases. All places count, suppressed or not, and their labels stay.
BASE = [("mit", "mit", "mit license"), ("apache", "apache", "apache license"), ("gpl", "general public", "general public license")]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    confidence: float
    pattern: str
    base: bool = False


def rules() -> list[Rule]:
    """All rules in order: base phrases, then signatures."""
    return [Rule(label, key, 2, 0.85, pattern, True) for label, key, pattern in BASE] + [Rule(*x) for x in SIGNATURES]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _detections(all_rules: list[Rule], joined: str) -> str:
    """SQL for the detections in a joined text: a, b first and last word, p priority, r rule, s confidence."""
    by_key: dict[str, list[int]] = {}
    for k, r in enumerate(all_rules):
        by_key.setdefault(r.keyword, []).append(k)

    def places(mark: str, ends: bool) -> str:
        return f"filter(transform(split(m, ' '), (w, i) -> CASE WHEN {'endswith' if ends else 'startswith'}(w, '{mark}') THEN i - 1 END), i -> i IS NOT NULL)"

    tries = []
    for key, group in by_key.items():
        found = ", ".join(
            f"""transform(array(regexp_replace({joined}, {_quote(f" ({r.pattern})(?= )")}, ' {OPEN}$1{CLOSE}')), m -> CASE WHEN contains(m, '{OPEN}') THEN zip_with({places(OPEN, False)}, {places(CLOSE, True)},
            (a, b) -> named_struct('a', a, 'b', b, 'p', {r.priority}, 'r', {k}, 's', {r.confidence}D, 'label', {_quote(r.label)}, 'base', {str(r.base).lower()})) END)[0]"""
            for k, r in ((k, all_rules[k]) for k in group)
        )
        tries.append(f"CASE WHEN contains({joined}, {_quote(key)}) THEN flatten(filter(array({found}), x -> x IS NOT NULL)) END")
    return f"array_sort(flatten(filter(array({', '.join(tries)}), x -> x IS NOT NULL)))"


def _kept(found: str) -> str:
    """SQL for the detections that are not suppressed."""
    reach = " ".join(f"WHEN size(d) <= {k} OR NOT exists(sequence(0, size(d) - 1 - {k}), i -> d[i + {k}].a - d[i].a < {MAX_WORDS}) THEN {k}" for k in REACH)
    better = "(e.a <= x.a AND e.b >= x.b AND e.b - e.a > x.b - x.a AND e.p >= x.p) OR (x.a <= e.a AND x.b >= e.b AND e.p > x.p) OR (e.a = x.a AND e.b = x.b AND e.p = x.p AND e.r < x.r)"
    near = "slice(z.d, greatest(i - z.n, 0) + 1, 2 * z.n + 1)"
    sized = f"transform(array({found}), d -> named_struct('d', d, 'n', CASE {reach} ELSE size(d) END))"
    return f"transform({sized}, z -> filter(z.d, (x, i) -> NOT exists({near}, e -> {better})))[0]"


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and `detections`, what is left after suppression:
    an array of (first word, last word, priority, rule, confidence, label, base), words from 0."""
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    low, joined, found, base = (unused(docs, f"license {x}") for x in ("low", "joined", "found", "base"))
    gate = " OR ".join(f"contains(`{low}`, {_quote(k)})" for k in GATE)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    a = docs.drop(*own).withColumns({"n_words": F.regexp_count(whole, F.lit(WORD)).cast("long"), low: F.lower(whole)})
    words = F.array_join(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), " ")
    a = a.withColumn(joined, F.when(F.expr(gate), F.concat(F.lit(" "), ascii_lower(words), F.lit(" "))))
    a = a.withColumn(found, F.expr(f"CASE WHEN `{joined}` IS NOT NULL THEN {_detections(rules(), f'`{joined}`')} END"))
    a = a.withColumn(base, F.expr(f"filter(`{found}`, x -> x.base)"))
    a = a.withColumn("detections", F.expr(f"CASE WHEN size(`{found}`) > 0 THEN {_kept(f'`{found}`')} ELSE array() END"))
    return a.withColumns(
        {
            "n_base": F.greatest(F.coalesce(F.size(base), F.lit(0)), F.lit(0)).cast("long"),
            "first_word": F.expr(f"CAST(array_min(transform(`{base}`, x -> x.a)) AS BIGINT)"),
            "last_word": F.expr(f"CAST(array_max(transform(`{base}`, x -> x.a)) AS BIGINT)"),
            "base_labels": F.expr(f"coalesce(array_join(array_sort(array_distinct(transform(`{base}`, x -> x.label))), ','), '')"),
            "labels": F.expr(f"array_join(array_sort(array_union(transform(detections, x -> x.label), coalesce(transform(`{base}`, x -> x.label), array()))), ',')"),
            "score": F.expr("coalesce(array_max(transform(detections, x -> x.s)), 0D)"),
        }
    ).drop(low, joined, found, base)

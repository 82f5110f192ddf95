"""Quality rules: an ordered decision list learned by sequential covering, applied as Spark conditional expressions.

Everything here is DataFrame functions; the learner itself is plain Python over a bounded sample of labelled statistics.

Cases: a null or empty text has no words and every statistic 0, so it fails the base rule (under 20 words). Repeated rows and
repeated or null ids are judged row by row. Very long texts are judged whole; ties in the learning data go to the first threshold. An empty table gives an empty
result. Extra columns pass through; the names this operator adds replace columns of the same name. With no labelled rows the list is empty and only the base rule rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

SPACES = " \t\n\x0b\f\r"
WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of a rule: name and SQL over the statistics. All are 0 for an empty text.
FEATURES = {
    "words": "double(n_words)",
    "symbol_share": "n_symbols / greatest(word_chars, 1L)",
    "word_length": "word_chars / greatest(n_words, 1L)",
    "dup_line_share": "n_dup_lines / greatest(_n_lines, 1L)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1L)",
    "upper_share": "_n_upper / greatest(word_chars, 1L)",
    "exclaim_share": "_n_exclaim / greatest(n_words, 1L)",
}
#: Columns that statistics need on the way.
HELPERS = {"_t", "_w", "_lines", "_h", "_s", "_pos", "_n_lines", "_n_upper", "_n_exclaim"}
#: Labelled rows that the list is learnt from, at most; the ones with the smallest hash of their id.
MAX_FIT_ROWS = 3000


def _expr(sql: str) -> Column:
    return F.expr(sql)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of each row's whole text, and three helper columns whose names start with `_n_`.

    Windows are compared by hash first. Only windows whose hash occurs twice or more in their text are sorted as strings, next to their
    positions, so the count is exact; sorting keeps a long text at n log n.
    """
    kept = docs.drop(*STATS, "_t", "_w", "_n_lines", "_n_upper", "_n_exclaim", "_rep", "_pos")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    flat = t
    for c in SPACES[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))  # then one plain character splits, without a regular expression
    a = kept.withColumn("_t", t).withColumn("_lines", lines).withColumn("_w", F.array_remove(F.split(flat, " "), ""))
    a = a.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long"),
            "_n_upper": F.regexp_count("_t", F.lit("\\p{Lu}")).cast("long"),
            "_n_exclaim": F.regexp_count("_t", F.lit("!")).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": _expr(f"CASE WHEN size(_w) > {WINDOW} THEN transform(_w, x -> xxhash64(x)) END"),
        }
    )
    for k in (1, 2, 4):  # hashes of 1, 2, 4, then WINDOW = 8 words
        a = a.withColumn("_h", _expr(f"CASE WHEN _h IS NOT NULL THEN zip_with(slice(_h, 1, size(_h) - {k}), slice(_h, {k + 1}, size(_h) - {k}), (x, y) -> xxhash64(x, y)) END"))
    # the places of windows whose hashes occur twice or more
    a = a.withColumn("_s", _expr("CASE WHEN size(_h) > size(array_distinct(_h)) THEN sort_array(transform(_h, (h, i) -> struct(h, i))) END"))
    a = a.withColumn(
        "_s",
        _expr("CASE WHEN _s IS NOT NULL THEN filter(_s, (x, i) -> (i > 0 AND get(_s, i - 1).h = x.h) OR (i < size(_s) - 1 AND get(_s, i + 1).h = x.h)) END"),
    )
    # words hold no space, so joined windows are equal only if all words are
    a = a.withColumn("_s", _expr(f"CASE WHEN _s IS NOT NULL THEN sort_array(transform(_s, x -> struct(array_join(slice(_w, x.i + 1, {WINDOW}), ' ') AS k, x.i AS p))) END"))
    a = a.withColumn(
        "_pos",
        _expr(
            """CASE WHEN size(_s) > 0 THEN sort_array(transform(filter(transform(sequence(0, size(_s) - 1), i -> struct(
                 (i > 0 AND get(_s, i - 1).k = get(_s, i).k) OR (i < size(_s) - 1 AND get(_s, i + 1).k = get(_s, i).k) AS r, get(_s, i).p AS p)),
                 x -> x.r), x -> x.p)) END"""
        ),
    )
    covered = f"""CASE WHEN _pos IS NULL OR size(_pos) = 0 THEN 0L ELSE {WINDOW} + aggregate(sequence(0, size(_pos) - 1), 0L,
        (s, i) -> s + CASE WHEN i = 0 THEN 0 ELSE least({WINDOW}, get(_pos, i) - get(_pos, i - 1)) END) END"""
    # an expression that isn't deterministic keeps filters above: pushed down, they would repeat the nested expressions many times over
    return a.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, _expr(covered))).drop("_t", "_w", "_lines", "_h", "_s", "_pos")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects a row that meets every (feature, '<=' or '>', threshold)."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float

    def column(self) -> Column:
        return _expr(" AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.conditions))

    def covers(self, row: dict) -> bool:
        return all((row[f] > t) == (op == ">") for f, op, t in self.conditions)


def learn(rows: list[dict], target: str = "bad", least_support: int = 5, least_precision: float = 0.9, max_rules: int = 12, max_conditions: int = 4, bins: int = 24) -> list[Rule]:
    """Sequential covering over at most a few thousand rows of features and a 0/1 target.

    Each rule grows by the condition of largest information gain on two thirds of the rows still uncovered, is pruned from its end by
    (p - n) / (p + n) on the other third, and is taken if its precision over both is high enough and it covers enough targets.
    """
    from math import log2

    left, rules = [r | {"_fold": k % 3} for k, r in enumerate(rows)], []
    while len(rules) < max_rules and sum(r[target] for r in left) >= least_support:
        grow, prune = [r for r in left if r["_fold"]], [r for r in left if not r["_fold"]]
        conditions: list[tuple[str, str, float]] = []
        inside = grow
        while len(conditions) < max_conditions and any(not r[target] for r in inside):
            p, n = sum(r[target] for r in inside), len(inside)
            best = (0.0, None)
            for f in FEATURES if p else ():
                values = sorted({r[f] for r in inside})
                # half-way between neighbouring values, so a rule keeps its distance from what it must not cover
                cuts = {(values[k] + values[k + 1]) / 2 for k in {(len(values) - 1) * k // bins for k in range(bins)} if k + 1 < len(values)}
                for t in sorted(cuts):
                    above = [r[target] for r in inside if r[f] > t]
                    for op, k, hit in ((">", len(above), sum(above)), ("<=", n - len(above), p - sum(above))):
                        if 0 < k < n and hit >= least_support // 2 + 1:
                            gain = hit * (log2(hit / k) - log2(p / n))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, op, t))
            if best[1] is None:
                break
            conditions.append(best[1])
            inside = [r for r in inside if Rule((best[1],), 0).covers(r)]
        if not conditions:
            break

        def worth(k: int, of: list[dict] = prune, c: list = conditions) -> float:
            hit = [r[target] for r in of if Rule(tuple(c[:k]), 0).covers(r)]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        k = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(conditions[:k]), 0.0)
        hit = [r[target] for r in left if rule.covers(r)]
        if sum(hit) < least_support or sum(hit) / len(hit) < least_precision:
            break
        rules.append(Rule(rule.conditions, sum(hit) / len(hit)))
        left = [r for r in left if not rule.covers(r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> list[Rule]:
    """Learn from the labelled rows with the smallest hash of their id, `max_rows` at most (labels: doc_id, quality; of repeated ids the lowest label)."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("_q")).where("doc_id IS NOT NULL AND _q IS NOT NULL").groupBy("doc_id").agg(F.min("_q").alias("_q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")
    # repeated ids must not swell the sample: the bound holds for the rows that come back, too
    found = with_stats(texts.repartition(32, "doc_id")).selectExpr("_q", "doc_id", *[f"double({v}) AS {k}" for k, v in FEATURES.items()])
    rows = [r.asDict() | {"bad": int(r["_q"] == 0)} for r in found.orderBy(F.xxhash64("doc_id"), *FEATURES).limit(max_rows).collect()]
    return learn(rows)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the statistics, base_failed, the number of the first rule that fires (null: none), its precision as `reject_score`, and kept."""
    # columns of users that are named like a helper step aside
    aside = {c: unused(docs, f"aside {c}") for c in docs.columns if c.lower() in HELPERS}
    a = with_stats(docs.drop("base_failed", "kept", "rule_id", "reject_score").withColumnsRenamed(aside)).withColumn("base_failed", base_failed())
    number, sure = F.lit(None).cast("int"), F.lit(0.0)
    for k, rule in reversed(list(enumerate(rules))):  # the first rule ends up outermost
        number, sure = F.when(rule.column(), F.lit(k)).otherwise(number), F.when(rule.column(), F.lit(rule.precision)).otherwise(sure)
    a = a.withColumns({"rule_id": number, "reject_score": sure})
    return a.withColumn("kept", ~F.col("base_failed") & F.col("rule_id").isNull()).drop("_n_lines", "_n_upper", "_n_exclaim").withColumnsRenamed({v: k for k, v in aside.items()})


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_rules(docs, fit(docs, labels))

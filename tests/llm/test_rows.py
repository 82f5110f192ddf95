"""Operators that judge documents: against brute force on odd rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import decontam, lang_ecoc, license_scan, near_dedup, quality_rules, toxicity, transducers


def same(found, expected):
    assert Counter(found) == Counter(expected)


def test_license_base_columns(docs, corpus, empty):
    out = license_scan.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    same(map(tuple, out), [(r[0], *brute.licenses(r[1])) for r in corpus])
    assert license_scan.license_scan(empty).count() == 0


def _scan(spark, *texts):
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    return rows if len(rows) > 1 else rows[0]


def test_license_suppression(spark):
    row = _scan(spark, "Licensed under the Apache License, Version 2.0 and under the GNU Lesser General Public License")
    spans = [(d.a, d.b, d.label) for d in row.detections]
    assert spans == [(0, 7, "apache-2.0"), (11, 15, "lgpl")]  # the whole grant, not the name within it
    assert row.base_labels == "apache,gpl" and row.labels == "apache,apache-2.0,gpl,lgpl"
    assert len(license_scan.rules()) > 250


def test_licenses_without_the_word(spark):
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "GNU GPL v3": "gpl-3.0",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "code is licensed under MIT, see below": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa",
        "https://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "nothing of that kind stands here": "",
    }
    out = _scan(spark, *texts)
    assert [r.labels for r in out] == list(texts.values()) and all(r.score >= 0.85 for r in out[:-1]) and out[-1].score == 0
    denied = _scan(spark, "this is not the MIT license")
    assert denied.base_labels == "mit" and denied.score < 0.5 and "not-licensed" in denied.labels


def _least_texts(pattern):
    """Of a pattern all texts with what is optional left out, and the most words that it can have."""
    import re._parser as parser

    def texts(seq):
        out = [""]
        for op, v in seq:
            kind = str(op)
            if kind == "LITERAL":
                more = [chr(v)]
            elif kind == "IN":
                more = [chr(x) for k, x in v if str(k) == "LITERAL"] or [chr(v[0][1][0])]
            elif kind == "NOT_LITERAL":
                more = ["~"]
            elif kind == "SUBPATTERN":
                more = texts(v[3])
            elif kind == "BRANCH":
                more = [x for b in v[1] for x in texts(b)]
            else:
                more = ["".join([x] * v[0]) for x in (texts(v[2]) if v[0] else [""])]
            out = [o + m for o in out for m in more]
        return out

    def spaces(seq):
        part = {"SUBPATTERN": lambda v: spaces(v[3]), "BRANCH": lambda v: max(map(spaces, v[1])), "MAX_REPEAT": lambda v: spaces(v[2]) and v[1] * spaces(v[2]), "LITERAL": lambda v: v == 32}
        return sum(part.get(str(op), lambda v: 0)(v) for op, v in seq)

    tree = parser.parse(pattern)
    return texts(tree), spaces(tree) + 1


def test_keywords_and_gate_lose_no_signature():
    for r in license_scan.rules():
        texts, most = _least_texts(r.pattern)
        assert most <= license_scan.MAX_WORDS and all(r.keyword in t and any(g in t for g in license_scan.GATE) for t in texts), r


def test_license_detections_by_brute_force(spark):
    """Matches by Python's re over plain words, and suppression of all pairs."""
    rng = random.Random(6)
    pieces = [_least_texts(r.pattern)[0][0].replace("~", "z") for r in license_scan.rules()] + ["word", "version 2 0", "the", "licensed under", "gnu"] * 30
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for text, row in zip(texts, _scan(spark, *texts), strict=True):
        joined, found = f" {text} ", []
        for k, r in enumerate(license_scan.rules()):
            for m in re.finditer(f" ({r.pattern})(?= )", joined):
                a = joined[: m.start()].count(" ")
                found.append((a, a + m.group(1).count(" "), r.priority, k))
        left = [x for x in found if not any((e[0] <= x[0] and e[1] >= x[1] and e[1] - e[0] > x[1] - x[0] and e[2] >= x[2]) or (x[0] <= e[0] and x[1] >= e[1] and e[2] > x[2]) or (e[:3] == x[:3] and e[3] < x[3]) for e in found)]
        assert sorted((d.a, d.b, d.p, d.r) for d in row.detections) == sorted(left)


def test_license_detections_are_far_apart(spark):
    text = "mit license " * 3000
    row = license_scan.license_scan(spark.createDataFrame([(text,)], "text string")).select("n_base", "first_word", "last_word", F.size("detections").alias("k")).first()
    assert tuple(row) == (3000, 0, 5998, 5999)  # `mit license` 3000 times, `license mit` between them


def test_quality_statistics(docs, corpus, empty):
    out = quality_rules.apply_rules(docs, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    expected = []
    for r in corpus:
        s = brute.stats(r[1])
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        expected.append((r[0], *s, failed, not failed))
    same(map(tuple, out), expected)
    assert quality_rules.apply_rules(docs, []).select("_w", "_n_lines", "digest").distinct().collect() == [("x", "x", "x")]
    assert quality_rules.apply_rules(empty, []).count() == 0


def test_quality_rules_are_learned_and_ordered(spark):
    good = [(k, "plain words stand in a text of their own number " * 1 + " ".join(f"w{k}x{j}" for j in range(30)), 1) for k in range(90)]
    bad = [(k, " ".join(f"w{k}x{j}###" for j in range(30)), 0) for k in range(100, 160)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    rules = quality_rules.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert rules and rules[0].precision >= 0.9
    out = quality_rules.apply_rules(df, rules)
    assert out.where("kept").select("quality").distinct().collect() == [(1,)] and out.where("NOT kept").count() == 60
    assert quality_rules.fit(df.select("doc_id", "text"), df.select("doc_id", "quality").limit(0)) == []


def test_first_condition_has_the_largest_gain():
    """Against all features and thresholds; rules stop where nothing is gained, and what one covers is gone for the next."""
    from math import log2

    rng = random.Random(13)
    rows = [{f: rng.randint(0, 6) / 2 for f in quality_rules.FEATURES} for _ in range(120)]
    for r in rows:
        r["bad"] = int(r["words"] > 2 and r["symbol_share"] <= 1.5 or rng.random() < 0.03)
    found = quality_rules.learn(rows, least_precision=0.6, bins=200)
    grow = [r for k, r in enumerate(rows) if k % 3]
    p, n, best = sum(r["bad"] for r in grow), len(grow), 0.0
    for f in quality_rules.FEATURES:
        values = sorted({r[f] for r in grow})
        for a, b in zip(values, values[1:], strict=False):
            for side in (True, False):
                inside = [r["bad"] for r in grow if (r[f] > (a + b) / 2) == side]
                if sum(inside) >= 3 and len(inside) < n:
                    best = max(best, sum(inside) * (log2(sum(inside) / len(inside)) - log2(p / n)))
    f, op, t = found[0].conditions[0]
    inside = [r["bad"] for r in grow if (r[f] > t) == (op == ">")]
    assert abs(sum(inside) * (log2(sum(inside) / len(inside)) - log2(p / n)) - best) < 1e-9
    left = rows
    for rule in found:
        hit = [r for r in left if rule.covers(r)]
        assert abs(sum(r["bad"] for r in hit) / len(hit) - rule.precision) < 1e-9 and rule.precision >= 0.6
        left = [r for r in left if not rule.covers(r)]
    assert {c[0] for c in found[0].conditions} == {"words", "symbol_share"}
    assert quality_rules.learn([], "bad") == []


def test_near_duplicates(docs, corpus, empty):
    out = near_dedup.near_duplicates(docs).collect()
    expected = brute.components([(r[0], r[1]) for r in corpus])
    same([(r.doc_id, r.n_shingles, r.component_id) for r in out], [(r[0], *e) for r, e in zip(corpus, expected, strict=True)])
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_keep_links_that_the_star_misses(spark):
    """A chain in which far ends are unlike, and members that all share bands with an unlike smallest key."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[15 * k : 15 * k + 160])) for k in range(12)]  # neighbours overlap in 141 of 171 shingles
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    expected = [c for _, c in brute.components(rows)]
    assert [out[k] for k in range(12)] == expected and set(expected) == {0}


def test_signatures_rule_out_unlike_pairs_alone():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 127, 128, 130, 700):
        base = np.unique(rng.integers(-(2**62), 2**62, 2 * n))
        one = np.sort(base[:n])
        a = int.from_bytes(near_dedup.signature(one), "little")
        for m in {max(1, 3 * n // 4), n, n + n // 3}:
            for drop in range(0, n, max(1, n // 9)):
                two = np.sort(base[drop : drop + m])
                both = len(np.intersect1d(one, two))
                may = near_dedup.may_link(n, a, m, int.from_bytes(near_dedup.signature(two), "little"))
                assert may or 100 * both < 75 * (n + m - both)
                assert not may or n < 50 or 100 * both >= 60 * (n + m - both)


def test_pairs_within_and_across_chunks():
    base = np.arange(60)
    sets = [base[:k] for k in (60, 50, 48, 30, 45)]
    members = [(bytes([k]), bytes([k]), 0, len(s), int.from_bytes(near_dedup.signature(s), "little")) for k, s in enumerate(sets)]
    like = {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)}
    assert {(u[0], v[0]) for u, v in near_dedup.pairs_within(members, False)} == like
    assert len(near_dedup.pairs_within(members, True)) == 3
    sided = [(k, c, i % 2, n, s) for i, (k, c, _, n, s) in enumerate(members)]
    assert {(u[0], v[0]) for u, v in near_dedup.pairs_within(sided, False)} == {(0, 1), (2, 1), (4, 1)}
    assert near_dedup.pairs_within([(k, b"c", s, n, x) for k, _, s, n, x in members], False) == []


def test_prefixes_meet():
    for n in range(1, 60):
        for m in range(n, 60):
            for both in range(n + 1):
                if 100 * both >= 75 * (n + m - both):
                    # the others are ordered before all that both have
                    assert n - both < near_dedup.prefix_length(n) and m - both < near_dedup.prefix_length(m)


def _groups(monkeypatch):
    seen = {}
    plain = near_dedup.chunk_pairs

    def spied(shingles):
        out = plain(shingles)
        counts = out.groupBy("shingle", "i", "j").count().agg(F.max("count"), F.sum("count")).first()
        seen.update(most=counts[0] or 0, rows=counts[1] or 0)
        return out

    monkeypatch.setattr(near_dedup, "chunk_pairs", spied)
    return seen


def test_pages_of_one_template_are_not_compared(spark, monkeypatch):
    """6,000 pages share two thirds of their words, so all share buckets; none is like another, and they have no rare shingle in common."""
    rng, seen = random.Random(4), _groups(monkeypatch)
    template = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(template + [f"u{rng.randrange(10**9)}" for _ in range(60)])) for k in range(6000)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    assert out.where("kept").count() == 6000 and seen["most"] <= 2 * near_dedup.BLOCK and seen["rows"] <= 6000


def test_texts_of_shared_passages_alone(spark, monkeypatch):
    """No shingle is rare, so rare ones are dealt to chunks; all links are found."""
    rng, seen = random.Random(5), _groups(monkeypatch)
    passages = [[f"p{i}w{k}" for k in range(25)] for i in range(12)]
    rows = [(k - 250, " ".join(w for i in rng.sample(range(12), 7) for w in passages[i])) for k in range(500)] + [(None, " ".join(passages[0]))]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in out], [(i, *e) for (i, _), e in zip(rows, brute.components(rows), strict=True)])
    assert 0 < seen["most"] <= 2 * near_dedup.BLOCK


def test_chunk_pairs_meet_once(spark):
    rows = [(s, bytes([k]), bytes([0 if k < 60 else k])) for s in (1, 2) for k in range(100)] + [(3, bytes([k]), bytes([7])) for k in range(100)]
    out = near_dedup.chunk_pairs(spark.createDataFrame(rows, "shingle bigint, key binary, comp binary"), 8).collect()
    met = Counter()
    groups = {}
    for r in out:
        groups.setdefault((r.shingle, r.i, r.j), []).append((r.side, bytes(r.key)))
    for (_, i, j), members in groups.items():
        left = [k for side, k in members if not side]
        right = [k for side, k in members if side]
        met.update(frozenset((a, b)) for a in left for b in (right if i != j else left) if a < b or i != j)
    assert {s for s, _, _ in groups} == {1}  # 2 has the same members, 3 one component
    expected = {frozenset((bytes([a]), bytes([b]))) for a in range(100) for b in range(a) if not (a < 60 and b < 60)}
    assert set(met) == expected and set(met.values()) == {1}


def test_decontamination(spark, docs, corpus, empty):
    items = [(1, " ".join(corpus[4][1].split()[5:35])), (10, " ".join(corpus[6][1].split()[:9]).upper()), (2, "two words"), (3, None), (4, ""), (10, "a b c d e f"), (None, "one"), (5, " ".join(corpus[7][1].split()[10:20]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = []
    for r in corpus:
        n, hit, k, names = brute.contamination(r[1], items)
        expected.append((r[0], n, hit, k, hashlib.sha256(names.encode()).hexdigest(), hit > 0))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (decontam.BLOCK_WORDS, 12):  # one pass, and several
        same(map(tuple, decontam.decontamination(docs, bench, block_words=block).select(columns).collect()), expected)
    assert decontam.decontamination(empty, bench).count() == 0
    assert decontam.decontamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_language_id(spark, docs, corpus, empty):
    model = lang_ecoc.fit_sample(docs.select("doc_id", "text", "lang"))
    out = lang_ecoc.predict(docs, model).collect()
    assert len(out) == len(corpus)
    for r in out:
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.ambiguous)
    assert lang_ecoc.fit_sample(empty) is None and lang_ecoc.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert lang_ecoc.predict(empty, model).count() == 0


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    out = lang_ecoc.predict(docs.where(held), lang_ecoc.fit_sample(docs.where(~held)))
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert right >= 0.95 * n


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 12):
        code = lang_ecoc.codewords(n)
        gaps = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(gaps) >= max(1, code.shape[1] // 4)


def test_toxicity_on_held_out_rows(spark, docs, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = toxicity.fit(d, labels.where(~held), 3000)
    out = toxicity.score(d.join(labels.where(held), "doc_id"), model).select("toxic", "score").collect()
    hit = [r.score >= 0.7 for r in out if r.toxic]
    wrong = [r.score >= 0.7 for r in out if not r.toxic]
    assert sum(hit) >= 0.7 * len(hit) and sum(wrong) <= 0.01 * len(wrong)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(d, labels.limit(0)).layer is None


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon(50, 500, {"fool": (40, 1), "blockhe*": (30, 2)})
    a = lexicon.automaton()
    one = lambda t: toxicity.channels(t, lexicon, a).tolist()
    plain, aimed = one("one fool here")[0], one("you fool")[0]
    assert aimed > plain > 0 and one("such fool here")[0] > plain
    assert one("she is not a fool at all")[1] > 0 and one("she is not a fool at all")[0] == 0
    assert one("he said: what a fool")[2] > 0 and one("he said so. what a fool")[2] == 0
    assert one("Blockheads!")[0] > 0 and one("foolish unfool")[0] == 0 and one("")[5] == 0
    assert one("they will kill it")[3] > one("they kill it")[3] > 0
    # clauses have any length: a verb of speech and a negation far off, and a target that comes after
    assert one("he said " + "word " * 5000 + "fool")[2] > 0 and one("word " * 100_000 + ", not one fool")[1] > 0
    assert one("fool as a word you")[0] == aimed and one("fool as a word or you")[0] == plain


def test_composition_follows_the_machines_one_by_one():
    """The composed machine has the paths of the cascade, and the runner finds the best of them."""
    rng = random.Random(8)
    parts, whole = toxicity.machines(), toxicity.grammar()
    runner = transducers.Runner(whole)

    def cascade(symbols, k=0):
        """(factor of each symbol, written) of every path through the machines from k on."""
        if k == len(parts):
            return [([1.0] * len(symbols), symbols)]
        out = []
        for path in parts[k].paths(symbols):
            out += [([a.factor * f for a, f in zip(path, rest, strict=True)], written) for rest, written in cascade([a.written for a in path], k + 1)]
        return out

    for _ in range(400):
        symbols = [rng.choice("OOYNRMDITII") for _ in range(rng.randint(0, 9))]
        weights = [rng.choice([1.0, 2.5]) if x in "IT" else 0.0 for x in symbols]
        expected = [sum(f * w for f, w in zip(fs, weights, strict=True)) for fs, _ in cascade(symbols)]
        composed = [sum(a.factor * w for a, w in zip(p, weights, strict=True)) for p in whole.paths(symbols)]
        assert sorted(round(x, 9) for x in expected) == sorted(round(x, 9) for x in composed) and composed
        total, sums, largest = runner.best(zip(symbols, weights, strict=True))
        assert abs(total - max(composed)) < 1e-9 and abs(sum(sums.values()) - total) < 1e-9 and largest <= total + 1e-9


def test_runner_fails_where_no_path_is_accepted():
    m = transducers.Machine(0, frozenset([1]), (transducers.Arc(0, "a", "x", 2.0, 1), transducers.Arc(0, "a", "y", 3.0, 2)))
    assert transducers.Runner(m).best([("a", 1.0)]) == (2.0, {"x": 2.0}, 2.0) and transducers.Runner(m).best([]) is None and list(m.paths("ab")) == []

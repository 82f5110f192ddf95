"""Texts beyond the sizes at which operators work in parts."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import arrowtext, decontam, lang_ecoc, license_scan, near_dedup, packing, quality_rules, toxicity


@pytest.fixture(scope="module")
def long_text():
    """About 1.3 MB, a repeated window and a word of 1.2 MB among it."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    body = [rng.choice(words) for _ in range(20_000)]
    body[3000:3008] = body[100:108]
    return " ".join([*body[:9000], "x" * 1_200_000, "MIT", "License", *body[9000:]])


def test_hashes_do_not_depend_on_parts(monkeypatch):
    texts = ["one two threefourfive six", "threefourfive one " + "y" * 100, "y" * 100 + " two", "y" * 99 + "z"]
    found = []
    for part in (1 << 20, 16):
        monkeypatch.setattr(arrowtext, "_PART", part)
        monkeypatch.setattr(arrowtext, "_tables", [])
        h, at = arrowtext.word_hashes(*arrowtext.text_bytes(pa.array(texts)))
        assert at.tolist() == [0, 4, 7, 9, 10]
        words = [w for t in texts for w in t.split()]
        assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
        found.append(h)
    monkeypatch.setattr(arrowtext, "_tables", [])
    short = [i for i, w in enumerate(words) if len(w) <= 16]
    assert (found[0][short] == found[1][short]).all()


def test_language_of_a_text_in_parts(monkeypatch, long_text):
    raw = np.frombuffer(long_text.encode(), np.uint8)
    at = np.array([0, len(raw)])
    whole = lang_ecoc.features(raw, at)[0]
    monkeypatch.setattr(lang_ecoc, "PART", 100_000)
    parts = lang_ecoc.features(raw, at)[0]
    assert float(whole @ parts) > 0.9999


def test_statistics_and_licenses_of_a_long_text(spark, long_text):
    df = spark.createDataFrame([(1, long_text), (2, long_text[:-3])], "doc_id bigint, text string")
    row = quality_rules.apply_rules(df, []).where("doc_id = 1").select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").first()
    assert tuple(row) == brute.stats(long_text)
    row = license_scan.license_scan(df).where("doc_id = 1").select("n_words", "n_base", "first_word", "last_word", "base_labels").first()
    assert tuple(row) == brute.licenses(long_text) == (20_003, 1, 9001, 9001, "mit")


def test_near_copies_of_long_texts(spark, long_text):
    rows = [(5, long_text), (3, long_text + " more"), (9, long_text[: len(long_text) // 3])]
    out = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(out[i].n_shingles, out[i].component_id) for i, _ in rows] == [tuple(x) for x in brute.components(rows)] and out[5].component_id == 3


def test_windows_in_a_long_text(spark, long_text):
    items = [(1, " ".join(long_text.split()[15_000:15_030])), (2, "x" * 1_200_000), (3, "no such words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    row = decontam.decontamination(spark.createDataFrame([(1, long_text)], "doc_id bigint, text string"), bench).first()
    n, hit, k, _ = brute.contamination(long_text, items)
    assert (row.n_words, row.n_hit, row.n_items) == (n, hit, k) and k == 2


def test_packing_and_scoring_a_long_text(spark, long_text):
    df = spark.createDataFrame([(1, long_text), (2, "short")], "doc_id bigint, text string")
    out = packing.pack(df).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == len(brute.tokens([long_text])[0]) + 1
    lexicon = toxicity.Lexicon(50, 500, {"fool": (40, 1)})
    model = toxicity.Model(lexicon, np.ones(toxicity.WIDTH + 2))
    scores = {r.doc_id: r.n_clauses for r in toxicity.score(spark.createDataFrame([(1, long_text + " fool"), (2, "short")], "doc_id bigint, text string"), model).collect()}
    assert scores == {1: 1, 2: 0}

"""Language ID with more languages than the fit has room for at full rows each."""

import random

import numpy as np

from loomspark.llm import lang_ecoc


def _corpus(n):
    rng = random.Random(9)
    rows = []
    for lang in range(n):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(1000 * lang + k, " ".join(rng.choice(words) for _ in range(30)), f"l{lang:02}") for k in range(24 if lang < n - 4 else 8)]  # the last are rarer
    return rows


def test_rare_languages_beyond_64_are_learnt(spark):
    docs = spark.createDataFrame(_corpus(70), "doc_id bigint, text string, lang string").repartition(3)
    model = lang_ecoc.fit_sample(docs)
    assert model.languages == sorted({r[2] for r in _corpus(70)})
    out = lang_ecoc.predict(docs, model).where("lang >= 'l64'").collect()
    assert len(out) == 48 + 32 and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_rows_of_the_fit_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame(_corpus(70) + _corpus(70)[:24] * 40, "doc_id bigint, text string, lang string")  # one language with many rows of a hash
    sizes = []
    monkeypatch.setattr(lang_ecoc, "fit", lambda x, langs: sizes.append({k: langs.count(k) for k in set(langs)}))
    for each, most in ((500, 4000), (6, 4000), (500, 350), (500, 10)):
        lang_ecoc.fit_sample(docs, each, most)
    assert sizes[0]["l00"] == 57 and sizes[0]["l69"] == 8
    assert [set(x.values()) for x in sizes[1:]] == [{6}, {5}, {1}] and all(len(x) == 70 for x in sizes)


def test_decoding_and_codewords_as_written_out():
    rng = np.random.default_rng(2)
    for n in (3, 9, 70):
        code = lang_ecoc.codewords(n)
        m = lang_ecoc.Model([str(k) for k in range(n)], code, rng.normal(size=(lang_ecoc.BUCKETS, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]), rng.random(code.shape[1]))
        x = rng.normal(size=(5, lang_ecoc.BUCKETS)).astype(np.float32) / 50
        f = np.clip(x @ m.weights + m.bias, -3, 3)
        loss = (np.exp(-f[:, None, :] * code[None]) * m.trust).sum(2)
        assert (m.decode(x)[0] == loss.argmin(1)).all()
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= max(1, code.shape[1] // 4)

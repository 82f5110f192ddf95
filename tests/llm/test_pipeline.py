import collections

import brute
import pytest
from brute import clashing

pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = pipeline.written(stage(spark, docs, D), "test")
        if k < 4:
            assert out.columns == docs.columns and 0 < out.count() <= n
            n, docs = out.count(), out
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def same(a, b):
    assert collections.Counter(map(str, map(tuple, a))) == collections.Counter(map(str, map(tuple, b)))


def test_near_duplicates_by_brute_force(spark, corpus):
    """Repeated rows, repeated and null ids, rows without words; one row of each group stays, with all its columns."""
    text = " ".join(f"w{k}" for k in range(50))
    rows = [*corpus, (7000, text, "x", "s", 1), (7001, "other " + text, "x", "s", 1), (7001, text, "x", "s", 1), (7001, text, "x", "s", 1), (None, "", None, None, None), (None, "", None, None, None), (None, None, None, None, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert [c for c in docs.columns if c == "_id"]
    out = pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    groups = collections.defaultdict(list)
    for k, top in enumerate(brute.roots([(r[0], r[1]) for r in rows])):
        key = top if brute.shingles(rows[k][1]) else ("none", rows[k][0], rows[k][1])
        groups[key].append((rows[k][0], rows[k][1]))
    found = [(r.doc_id, r.text) for r in out.collect()]
    assert len(found) == len(groups)
    for members in groups.values():
        here = [x for x in set(members) if x in found]
        least = min((x[0] for x in members if x[0] is not None), default=None)
        assert len(here) == 1 and found.count(here[0]) == 1 and here[0][0] == least
    assert all(r["_id"] == "mine" and r["kept"] == "mine" for r in out.collect())


def test_quality_by_brute_force(spark, corpus, tmp_path):
    """The base rule by its plain statement and the learned list by a plain reading of its conditions."""
    rng_words = "lorem ipsum dolor sit amet".split()
    rows = [*corpus, *[(5000 + k, " ".join(f"{rng_words[(i * 7 + k) % 5]}{i}{k}{'$' if k % 2 else ''}" for i in range(40)), "x", "s", 1) for k in range(80)]]
    labels = [(5000 + k, 1 - k % 2, 0) for k in range(80)] + [(None, 0, 0), (5001, 1, None), (77777, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    out = pipeline.quality(spark, docs, str(tmp_path))
    rules = pipeline.quality_rules.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rules and out.columns == docs.columns
    same([(r.doc_id, r.text) for r in out.collect()], [(r[0], r[1]) for r in rows if brute.quality(r[1], rules)])
    assert all(r["kept"] == "mine" and r["n_words"] == "mine" for r in out.collect())


def test_language_by_brute_force(spark, corpus, tmp_path):
    rows = [(9000 + k, " ".join(["der die das und nicht"] * 9 + [f"wort{k}"]), "de", "s", 1) for k in range(30)] + [(9100 + k, " ".join(["the of and to not"] * 9 + [f"word{k}"]), "en", "s", 1) for k in range(30)]
    rows += [(None, None, "en", "s", 1), (9000, "", None, "s", 1), (1, "12 34", "en", "s", 1), (1, "nicht und", None, "s", 1), (1, "nicht und", None, "s", 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    out = pipeline.language_id(spark, docs, "")
    model = pipeline.lang_ecoc.fit_sample(docs)
    kept = [(r[0], r[1]) for r in rows if (found := brute.language(r[1], model)) and not found[2]]
    assert out.columns == docs.columns and 60 <= len(kept) < len(rows)
    same([(r.doc_id, r.text) for r in out.collect()], kept)


def test_packing_covers_the_stage_before(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = pipeline.pack(spark, clashing(docs), "").collect()
    total = collections.Counter()
    for p in out:
        total[p.sequence_id] += p.length
    tokens = brute.tokens([r[1] for r in corpus])
    assert sum(total.values()) == sum(map(len, tokens)) + len(corpus) and max(total.values()) <= 2048


def test_empty_table_passes(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, D)
        assert out.count() == 0


def test_decontamination_by_items_of_every_length(spark, tmp_path):
    """A verbatim item rejects a document, also one of fewer words than a window."""
    words = [f"w{k}" for k in range(12)]
    for n in range(1, 13):
        items = [(n, " ".join(words[:n])), (99, None)]
        spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        rows = [(k, f"before {' '.join(words[:k]).upper()}, after") for k in range(14)] + [(50, None), (51, ""), (None, "w0 w1"), (52, "w1 w0 w1")]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        out = pipeline.decontamination(spark, docs, f"{tmp_path}/{n}").collect()
        clean = [r for r in rows if not brute.contamination(r[1], items)[1]]
        assert sorted(map(str, map(tuple, out))) == sorted(map(str, clean)) and 0 < len(clean) < len(rows)

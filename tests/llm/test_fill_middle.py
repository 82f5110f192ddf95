"""Fill-in-middle: the automaton against regular expressions, whole texts against a plain version and SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import fill_middle as fm
from loomspark.llm.arrowtext import text_bytes
from loomspark.llm.catalog import ORACLES, QUERIES

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    text = text or ""
    u = UNITS.findall(text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[k : k + 8], 16) for k in (0, 8, 16, 24)]
    x, y = sorted(v % (len(u) + 1) for v in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(u), "plain", None, None, text
    a, b, c = "".join(u[:x]), "".join(u[x:y]), "".join(u[y:])
    return (doc_id, len(u), *(("spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else ("psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "Zz", "<", ">", "P", "S", "M", "é", "日本", "😀", " ", "\n", "<P", "S>", "1"]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return [(k - 5, t) for k, t in enumerate(texts)] + [(7, None), (None, "some text of words"), (None, None), (8, ""), (8, ""), (9, "<P>"), (10, "<P>" * 3), (11, "x<M"), (12, "S>"), (13, "[a{z@Z`")]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1 << 20])
def test_scan_in_blocks(odd, block):
    texts = [t or "" for _, t in odd]
    raw, at = text_bytes(pa.array(texts))
    scan = fm.Scan(raw, at, block=block)
    units = [UNITS.findall(t) for t in texts]
    assert np.diff(scan.unit_at).tolist() == list(map(len, units)) and np.diff(scan.point_at).tolist() == list(map(len, texts))
    assert scan.marked.tolist() == [bool(re.search("<[PSM]>", t)) for t in texts]
    rng = random.Random(1)
    of = [(d, rng.randint(0, len(u))) for d, u in enumerate(units)]
    place, points = scan.cuts(*map(np.array, zip(*of, strict=True)))
    for (d, k), p, c in zip(of, place.tolist(), points.tolist(), strict=True):
        front = "".join(units[d][:k])
        assert c == len(front) and p - at[d] == len(front.encode())


@pytest.mark.parametrize("sentinels", [("<P>", "<S>", "<M>"), ("<|pre|>", "<|suf|>", "<|mid|>"), ("aab", "ab", "#")])
def test_any_sentinels(sentinels):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab#<|presufmid>é") for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|suf|>", "x"]) for _ in range(400)]
    for block in (2, 5, 1 << 20):
        scan = fm.Scan(*text_bytes(pa.array(texts)), sentinels, block)
        assert scan.marked.tolist() == [any(s in t for s in sentinels) for t in texts]
    with pytest.raises(ValueError):
        fm.automaton(("", "a", "b"))


def test_same_rows(spark, odd, docs, corpus):
    df = spark.createDataFrame(odd, "doc_id bigint, text string").repartition(4)
    for table, rows in ((df, odd), (docs, [(r[0], r[1]) for r in corpus])):
        out = fm.fill_in_middle(table).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
        assert sorted(map(tuple, out.collect()), key=str) == sorted((plain(*r) for r in rows), key=str)


def test_restored(spark, odd):
    df = spark.createDataFrame(odd, "doc_id bigint, text string")
    out = fm.fill_in_middle(df.withColumn("own", F.coalesce("text", F.lit("")))).where(fm.restored(F.col("form"), F.col("output")) != F.col("own"))
    assert out.count() == 0


def test_columns(spark, empty):
    df = spark.createDataFrame([(1, "some text", "x", 2, 3.0)], "doc_id int, text string, FORM string, n int, `other one` double")
    out = fm.fill_in_middle(df)
    assert out.columns == ["doc_id", "other one", *fm.RESULT] and out.first()["other one"] == 3.0
    assert fm.fill_in_middle(empty).count() == 0


def test_long_text(spark):
    text = "some words, é and 日本; " * 150_000
    rows = [(k, text[k:]) for k in range(6)]
    out = fm.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert sorted(map(tuple, out.collect())) == [plain(*r) for r in rows]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_exact_duplicates"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    expected = con.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, expected.fetchall()))

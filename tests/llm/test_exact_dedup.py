"""Exact duplicates: block names against plain grouping of whole texts."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.llm.exact_dedup import exact_duplicates, named


def plain(rows):
    """rows: (doc_id, text). Of each row (doc_id, keep_id, group_size, kept, digest)."""
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i or 0, k, i))
    out = []
    for t, members in groups.items():
        best = min(members)
        out += [(i, best[3], len(members), m == best, hashlib.sha256(t.encode()).hexdigest()) for m in members for i in [m[3]]]
    return sorted(out, key=str)


def found(df, **how):
    return sorted((tuple(r) for r in exact_duplicates(df, **how).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("size", [4, 4096])
def test_same_groups(docs, corpus, size):
    assert found(docs, size=size) == plain([(r[0], r[1]) for r in corpus])


def test_hashes_that_clash(docs, corpus):
    """With three values of the hash nearly every block is compared by its bytes."""
    assert found(docs, size=16, hashed=lambda b: F.pmod(F.xxhash64(b), F.lit(3))) == plain([(r[0], r[1]) for r in corpus])


def test_blocks_in_other_orders(spark):
    """Texts of the same blocks in other orders and numbers, white space of all kinds, nulls and repeated rows."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["aaaa", "bbbb", "cc dd"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    texts += ["a b", "a\t\x0b b", "a \n\n b", " a b", "a b ", "a\x1cb", "a b", "", None, " ", "\n", "é" * 9, "é" * 9 + " "]
    rows = [(rng.choice([k, k, k % 50, None]), t) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(df, size=4) == plain(rows)


def test_one_identity_for_each_text(docs):
    out = exact_duplicates(docs, size=8).groupBy("identity_level", "identity").agg(F.countDistinct("text_sha256").alias("t"), F.count("*").alias("n"), F.max("group_size").alias("g"))
    assert out.where("t <> 1 OR n <> g").count() == 0


def test_long_text_and_carried_columns(spark):
    body = "word " * 400_000
    rows = [(3, body, "x", 1), (1, body + "!", "y", None), (2, body.replace(" ", "\n"), None, 2), (4, None, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, `odd name.` string, Kept int")
    out = exact_duplicates(df, carry=("odd name.", "Kept"))
    assert out.columns == ["odd name.", "doc_id", "keep_id", "group_size", "kept", "text_sha256", "identity_level", "identity"]
    assert sorted(tuple(r)[:5] for r in out.collect() if r[0]) == [("x", 3, 2, 2, False), ("y", 1, 1, 1, True), ("z", 4, 4, 1, True)]


def test_names_are_in_order_and_once(spark):
    df = spark.createDataFrame([(k % 7, k % 3) for k in range(100)], "a int, b int")
    rows = named(df, "a", "b").collect()
    assert len({r.name for r in rows}) == len(rows) == 21
    assert all(x.name < y.name for x, y in zip(rows, rows[1:], strict=False))


def test_empty(spark, empty):
    assert exact_duplicates(empty).count() == 0

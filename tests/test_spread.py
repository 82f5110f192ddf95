"""What a task holds does not grow with the table: results come in as many parts as there are rows for, however small they are as bytes, and are the same in all."""

from pyspark.sql import functions as F

from loomspark.functions import ctokens
from loomspark.operators.spread import parts, spread


def test_parts(spark):
    rows = spark.range(100)
    assert [parts(rows, n) for n in (1, 30, 100, 1000)] == [100, 4, 1, 1]
    assert parts(rows, 1000, F.lit(30)) == 3 and parts(rows.where("id < 0"), 10, F.col("id")) == 1
    assert spread(rows, ["id"], 9).groupBy("id").count().rdd.getNumPartitions() == 9


def test_proofs_in_parts(spark, monkeypatch):
    pairs = spark.range(200).select("id", F.lit("x = (int) y;").alias("a"), F.when(F.col("id") % 2 == 0, "x=y").otherwise("q = r").alias("b"))
    monkeypatch.setattr(ctokens, "EACH", 1000, raising=False)
    found = ctokens.symbolic_proofs(pairs, ["id"], "a", "b", True)
    assert found.rdd.getNumPartitions() >= 6
    assert {(r["id"], r["proof"]) for r in found.collect()} == {(k, "alpha" if k % 2 else "canonical") for k in range(200)}
    assert ctokens.canonical_statements(pairs, ["id"], "a").rdd.getNumPartitions() >= 5


def test_frequent_items_pair_in_blocks(spark, monkeypatch):
    """Sets of frequent items in several blocks and slices, against brute force; no row for each pair that has an item in common is shuffled."""
    import random

    from loomspark.operators import joins

    rng = random.Random(5)
    sets = {side: {k: set(rng.sample(range(40), rng.randint(1, 25))) for k in range(n)} for side, n in (("a", 60), ("b", 90))}
    sets["b"][90] = sets["b"][7]  # of equals the smaller one
    frames = [spark.createDataFrame([(k, f"w{i}") for k, s in sets[side].items() for i in s] + [(0, None)], f"{side} bigint, w string") for side in "ab"]
    for name, n in (("BLOCK_SETS", 16), ("SLICE_ITEMS", 200)):
        monkeypatch.setattr(joins, name, n, raising=False)
    for least in (0.1, 0.3, 0.6):
        scores = {k: max((len(s & t) / len(s | t), -b) for b, t in sets["b"].items()) for k, s in sets["a"].items()}
        found = joins.jaccard_argmax(*frames, "a", "b", "w", least)
        assert {tuple(r) for r in found.collect()} == {(k, -b, round(j, 6)) for k, (j, b) in scores.items() if j >= least}
        assert least > 0.5 or "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def _in_parts(spark, monkeypatch, name):
    """Whether the query's rows over sf0.001 (6,000 line items) come in a part for each 500, as many as asked for."""
    from loomspark import plans
    from loomspark.plans import tables

    monkeypatch.setattr(tables, "EACH", 500, raising=False)
    return plans.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 12


def test_expected_position_in_parts(spark, monkeypatch):
    assert _in_parts(spark, monkeypatch, "expected_position")


def test_audit_tasks_in_parts(spark, monkeypatch):
    """Ranks are the same with slots above and below the bound, and small slots need no bounds."""
    from loomspark.operators import contracts

    rows = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 7 + 1).alias("f"), F.col("id").alias("c"), F.concat(F.lit("t"), F.col("id") % 11).alias("text"))
    ranked = lambda **k: {(r["f"], r["c"]): r["candidate_rank"] for r in contracts.audit_tasks(rows, ["f", "c"], "text", [F.col("c") % 50, F.col("c")], **k).collect()}
    expected = {}
    for f in range(8):
        own = [c for c in range(300) if (0 if c < 200 else c % 7 + 1) == f]
        expected |= {(f, c): k + 1 for k, c in enumerate(sorted(own, key=lambda c: (c % 50, c)))}
    assert ranked() == expected and ranked(whole=100) == expected and ranked(whole=1) == expected
    assert _in_parts(spark, monkeypatch, "audit_tasks")


def test_candidate_facts_in_parts(spark, monkeypatch):
    assert _in_parts(spark, monkeypatch, "candidate_facts")


def test_instance_checks_in_parts(spark, monkeypatch):
    assert _in_parts(spark, monkeypatch, "instance_checks")


def test_functions_in_parts(spark, monkeypatch):
    """Blocks of functions come in a part for each 500 of 6,000 rows, by function."""
    from loomspark.plans import flow

    monkeypatch.setattr(flow, "EACH", 500, raising=False)
    assert flow.blocks(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 12


def test_matched_slots_in_parts(spark, monkeypatch):
    """Slots are shuffled once, in parts of a fixed size, whatever their number; so are those of slot_audit."""
    from loomspark import plans

    for name in ("matched_slots", "slot_audit"):
        assert _in_parts(spark, monkeypatch, name)
        assert plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1

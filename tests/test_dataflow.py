"""Functions followed in one place have the facts that rounds give, in one shuffle however far facts go."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import batches
from loomspark.operators import dataflow as D


@pytest.fixture(scope="module")
def tables(spark):
    rng, accesses, edges = random.Random(3), [], []
    for k in range(30):
        n = rng.randint(1, 25)
        edges += [(f"g{k}", b, rng.randrange(n)) for b in range(n) for _ in range(rng.randint(0, 3))]
        accesses += [(f"g{k}", b, o, f"v{rng.randrange(5)}", rng.choice(["def", "use"])) for b in range(n) for o in range(rng.randint(0, 4))]
    edges += [("g0", None, 1), (None, 0, 1), ("only edges", 0, 1)]
    accesses += [("g1", 0, 0, None, "def"), ("only uses", 0, 0, "v0", "use"), (None, 0, 0, "v0", "use")]
    return spark.createDataFrame(accesses, "sample string, block bigint, ordinal int, value string, kind string").cache(), spark.createDataFrame(edges, "sample string, src bigint, dst bigint").cache()


@pytest.mark.parametrize("bound", [60, 0])
def test_same_as_rounds(tables, monkeypatch, bound):
    ask = lambda: [sorted(map(tuple, f(*tables).collect()), key=repr) for f in (D.liveness, D.reaching_definitions, D.def_use_chains)]
    one_place = ask()
    monkeypatch.setattr(D, "LARGEST", bound)
    assert one_place == ask() and all(one_place)


def test_a_long_way_takes_no_rounds(spark):
    n = 2000
    edges = spark.range(n - 1).select(F.lit(1).alias("sample"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    accesses = spark.createDataFrame([(1, 0, 0, 7, "def"), (1, n - 1, 0, 7, "use")], "sample int, block bigint, ordinal int, value int, kind string")
    leaving = accesses.where("kind = 'def'").select("sample", "block", "value")
    found, rounds = D.arrived(leaving, edges, leaving, ["value"])
    assert found.count() == n - 1 and rounds == 0
    assert [tuple(r) for r in D.def_use_chains(accesses, edges).collect()] == [(1, 7, n - 1, 0, 0, 0)]


def test_functions_are_whole_across_batches(spark):
    rows = spark.range(5000).select(F.expr("cast(sqrt(id) as bigint)").alias("sample"), "id")

    def run(given):
        import pyarrow as pa

        for table, starts in batches.whole(b for x in given for b in (x.slice(k, 37) for k in range(0, x.num_rows, 37))):
            yield pa.RecordBatch.from_pydict({"sample": [table["sample"][a].as_py() for a in starts[:-1]] if len(starts) > 1 else [], "n": [z - a for a, z in zip(starts, starts[1:])]}, pa.schema([("sample", pa.int64()), ("n", pa.int64())]))

    found = {r.sample: r.n for r in batches.in_batches(rows, run, "sample bigint, n bigint").collect()}
    assert found == {r.sample: r["count"] for r in rows.groupBy("sample").count().collect()}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_liveness_takes_no_further_shuffle(spark, tables):
    accesses, edges = (t.repartition(5, "sample") for t in tables)
    assert shuffles(D.liveness(accesses, edges)) == 2  # those of the two tables


def test_liveness_of_many_values_and_other_types(spark):
    n = 200  # values, more than a word has bits
    accesses = spark.range(n).selectExpr("1 AS sample", "'b' || id % 3 AS block", "cast(0 as bigint) AS ordinal", "cast(id as double) AS value", "IF(id % 7 = 0, 'def', 'use') AS kind")
    edges = spark.createDataFrame([(1, "b0", "b1"), (1, "b1", "b2"), (1, "b2", "b0"), (1, "b9", "b0")], "sample int, src string, dst string")
    found = {(r.block, int(r.value)): (r.live_in, r.live_out) for r in D.liveness(accesses, edges).collect()}
    used, defined = {(f"b{k % 3}", k) for k in range(n) if k % 7}, {(f"b{k % 3}", k) for k in range(0, n, 7)}
    every = {k for _, k in used}
    assert not any(k in every for _, k in defined)
    assert found == {(b, k): (b != "b9", True) if b != "b9" else (True, True) for b in ("b0", "b1", "b2", "b9") for k in every}


@pytest.fixture(scope="module")
def regions(spark):
    rng = random.Random(4)
    rows = [(f"g{k}", r, rng.randrange(25)) for k in range(30) for r in range(rng.randint(0, 4)) for _ in range(rng.randint(1, 9))]
    return spark.createDataFrame([*rows, *rows[:5], ("only regions", 0, 0), ("g1", None, 0), ("g1", 0, None), (None, 0, 0)], "sample string, region int, block bigint").cache()


@pytest.mark.parametrize("bound", [60, 0])
def test_regions_same_as_joins(tables, regions, monkeypatch, bound):
    ask = lambda: sorted(map(tuple, D.region_flow(*tables, regions).collect()), key=repr)
    one_place = ask()
    assert len(one_place) == regions.dropna().select("sample", "region").distinct().count() and all(any(r[k] for r in one_place) for k in range(2, 8))
    monkeypatch.setattr(D, "LARGEST", bound)
    assert one_place == ask()


def test_region_flow_takes_no_further_shuffle(tables, regions):
    assert shuffles(D.region_flow(*(t.repartition(5, "sample") for t in (*tables, regions)))) == 3  # those of the three tables


def test_known_sizes_spare_the_count(tables, regions, monkeypatch):
    sizes = regions.select("sample").distinct().selectExpr("sample", "IF(sample < 'g2', 100000L, 1L) AS n")
    ask = lambda *s: [sorted(map(tuple, f(*t, *s).collect()), key=repr) for f, t in ((D.liveness, tables), (D.region_flow, (*tables, regions)))]
    counted = ask()
    assert ask(sizes) == counted
    monkeypatch.setattr(D, "larger", None)  # not asked where no function is large
    assert ask(sizes.selectExpr("sample", "1L AS n")) == counted

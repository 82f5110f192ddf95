"""The index finds what the exact search finds."""

import time

import numpy as np
import pyarrow as pa
import pytest

from loomspark.operators import retrieval as E
from loomspark.operators.settle import settled


def test_recall_of_the_index(spark, monkeypatch):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    v = middle[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    rows = [(k, int(k % 7), x.tolist()) for k, x in enumerate(v)] + [(5000 + k, 9, v[0].tolist()) for k in range(700)]  # one cell holds a third
    df = spark.createDataFrame(rows, "id bigint, g int, v array<double>").repartition(5)
    monkeypatch.setattr(E, "BLOCK", 128)
    exact = {(r.id, r.other) for r in E.hard_negatives(df, "id", "g", "v", 5).collect()}
    found = E.hard_negatives_indexed(df, "id", "g", "v", 5).collect()
    assert len(exact) == 5 * 2200 and len({(r.id, r.rank) for r in found}) == len(found)
    scores = {(r.id, r.other): r.score for r in E.hard_negatives(df, "id", "g", "v", 5).collect()}
    worst = {}
    for (i, _), s in scores.items():
        worst[i] = min(worst.get(i, s), s)
    hits = sum(r.score >= worst[r.id] - 1e-9 for r in found)
    assert hits >= 0.9 * len(exact)
    groups = {k: g for k, g, _ in rows}
    assert all(groups[r.id] != groups[r.other] for r in found)
    assert E.hard_negatives_indexed(df.limit(0), "id", "g", "v", 5).count() == 0


def table(keys, groups, vectors, role):
    return pa.table({"key": keys, "g": groups, "role": [role] * len(keys), "v": pa.array(list(vectors), pa.list_(pa.float64()))})


def test_ties_and_short_rows_of_a_product():
    """The k best by rounded score, then by key, also where many rows are equal, few are allowed or none."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(-1, 2, (300, 3)).astype(float), rng.integers(-1, 2, (500, 3)) + 1e-8 * rng.normal(size=(500, 3))
    y[7] = np.nan
    kx, ky, gx, gy = rng.permutation(300), rng.permutation(500), rng.integers(0, 3, 300), np.where(np.arange(500) < 497, 0, 1)
    found = E._product(5)(pa.concat_tables([table(kx, gx, x, 0), table(ky, gy, y, 1)])).to_pydict()
    got = set(zip(found["key"], found["other"], found["score"]))
    score = np.round(x @ y.T, 6)
    want = set()
    for i in range(300):
        able = sorted((-score[i, j], ky[j]) for j in range(500) if gx[i] != gy[j] and np.isfinite(score[i, j]))[:5]
        want |= {(kx[i], j, -s) for s, j in able}
    assert got == want and len(found["key"]) == len(want)


def test_a_product_sorts_only_what_may_be_best():
    """Two full blocks: sorting all scores took over half a second (on a busy machine a multiple), the product itself some hundredths."""
    v = np.random.default_rng(2).normal(size=(2, 2048, 64))
    given = pa.concat_tables([table(np.arange(2048), np.arange(2048) % 5, v[r], r) for r in (0, 1)])
    run = E._product(5)

    def seconds(f):
        begin = time.perf_counter()
        f()
        return time.perf_counter() - begin

    every = v[0] @ v[1].T
    assert min(seconds(lambda: run(given)) for _ in range(3)) < seconds(lambda: np.argsort(-every, axis=1, kind="stable"))


@pytest.mark.parametrize("n", [40, 700])
def test_block_products_in_single_precision_miss_nothing(n):
    rng = np.random.default_rng(n)
    for scale in (1.0, 1e-3, 1e20):
        v = rng.normal(size=(2 * n, 8)) * scale
        v[: n // 2] = v[n : n + n // 2] * (1 + 1e-9 * rng.normal(size=(n // 2, 1)))  # nearly equal scores
        v[n : n + n // 2] = v[n : n + n // 2][:: -1] if n < 100 else v[n]  # ties: more copies than are computed one by one
        g, keys = rng.integers(0, 4, 2 * n), rng.permutation(2 * n)
        table = pa.table({"role": pa.array([0] * n + [1] * n, pa.int32()), "key": keys, "g": g, "v": pa.array(list(v))})
        found = E._product(5)(table).to_pydict()
        score = np.round((v[:n] @ v[n:].T), 6)
        wanted = []
        for q in range(n):
            c = sorted((-score[q, x], keys[n + x]) for x in range(n) if g[n + x] != g[q])[:5]
            wanted += [(keys[q], o, -s) for s, o in c]
        got = sorted(zip(found["key"], found["other"], found["score"], strict=True))
        if scale == 1e20:  # scores are too large to be rounded alike
            assert len(got) == len(wanted) and {x[0] for x in got} == {x[0] for x in wanted}
        else:
            assert [x[:2] for x in got] == [x[:2] for x in sorted(wanted)] and np.allclose([x[2] for x in got], [x[2] for x in sorted(wanted)])


def test_negatives_are_searched_once(spark, monkeypatch):
    from loomspark.plans import ranking

    asked = []
    monkeypatch.setattr(ranking, "settled", lambda df: asked.append(df) or settled(df))
    plan = ranking._with_negatives(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(asked) == 1 and "FlatMapGroupsInArrow" not in plan

"""Structure-constrained transport against a literal version, entry by entry."""

import numpy as np
import pandas as pd

from loomspark.operators import transport as O
from loomspark.plans import queries


def literal(cost, ga, gb, gamma, outer, epsilon, rounds, mu, nu, penalty, weight):
    n, m = cost.shape

    def plan(c):
        k, u, v = np.exp(-c / epsilon), np.ones(n), np.ones(m)
        for _ in range(rounds):
            u = np.array([mu[i] / sum(k[i, j] * v[j] for j in range(m)) for i in range(n)])
            v = np.array([nu[j] / sum(k[i, j] * u[i] for i in range(n)) for j in range(m)])
        return u[:, None] * k * v[None, :]

    c = np.array([[cost[i, j] + weight * penalty[i, j] for j in range(m)] for i in range(n)])
    phi = [[float(not gb[p, q]) if p != q else 0.0 for q in range(m)] for p in range(m)]
    x = plan(c)
    for _ in range(outer):
        grad = np.zeros((n, m))
        for i in range(n):
            for j in range(m):
                grad[i, j] = sum(ga[i, p] * x[p, q] * phi[q][j] + ga[p, i] * x[p, q] * phi[j][q] for p in range(n) for q in range(m))
        x = plan(c + gamma * grad)
    return x


def test_plan_against_a_literal_version():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 3), (4, 3), (5, 6)):
        for _ in range(4):
            cost, penalty = rng.random((n, m)), rng.random((n, m))
            ga, gb = (rng.random((n, n)) < 0.4).astype(float), (rng.random((m, m)) < 0.4).astype(float)  # loops, too
            mu, nu = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(m))
            found = O.structured_sinkhorn(cost, ga, gb, 0.7, 3, 0.2, 20, mu, nu, penalty, 0.4)
            assert np.allclose(found, literal(cost, ga, gb, 0.7, 3, 0.2, 20, mu, nu, penalty, 0.4), atol=1e-9)
            plain = O.structured_sinkhorn(cost, ga, gb)
            assert np.allclose(plain, literal(cost, ga, gb, 0.1, 5, 0.05, 20, np.full(n, 1 / n), np.full(m, 1 / m), 0 * penalty, 0.3), atol=1e-9)


def test_query_gives_masses_and_penalties(spark):
    d = "/root/testdata/sf0.001"
    out = queries()["structured_plan"](spark, d).toPandas()
    for _, plan in out.groupby("label"):
        got = plan.groupby("b")["value"].sum()
        mass = 1 + got.index.to_series() % 3
        assert np.allclose(got, mass / mass.sum(), atol=1e-6)


def test_kernel_gets_penalties_in_the_order_of_keys(spark):
    df = spark.createDataFrame([(1, 0, 7, [1.0], 1), (1, 0, 5, [1.0], 3), (1, 1, 4, [1.0], 2), (2, 0, 1, [1.0], 1)], "g int, side int, k int, v array<double>, mass int")
    penalty = spark.createDataFrame([(1, 7, 4, 0.25)], "g int, a int, b int, penalty double")
    kernel = lambda x, y, a, b, c: [(i, 0, float(c[i, 0] + 10 * a[i] + 100 * b[0])) for i in range(len(x))]
    out = O.per_pair_of_sets(df, "g", "side", "k", "v", kernel, "mass", penalty).toPandas()
    assert isinstance(out, pd.DataFrame) and sorted(map(tuple, out.itertuples(index=False))) == [(1, 5, 4, 108.5), (1, 7, 4, 102.75)]

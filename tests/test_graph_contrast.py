"""Graph contrast against a literal version, row by row."""

from math import exp, log, sqrt

import numpy as np
import pytest

from loomspark.operators import retrieval as E


def literal(rows, mode, tau, use):
    """rows: (a, b, uid, negatives of a, negatives of b)."""
    cos = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / sqrt(sum(p * p for p in x)) / sqrt(sum(q * q for q in y))
    if len(rows) == 1:
        return 1 - cos(rows[0][0], rows[0][1])
    total = 0.0
    for own, other, negatives in ((0, 1, 3), (1, 0, 4)):
        for i, r in enumerate(rows):
            sims = [cos(r[own], q[other]) / tau for q in rows]
            positives = [j for j, q in enumerate(rows) if (q[2] == r[2] if mode == "multi_positive" else j == i)]
            kept = [s for j, s in enumerate(sims) if mode == "multi_positive" or j == i or rows[j][2] != r[2]]
            kept += [cos(r[own], v) / tau for v in r[negatives] or []] if use else []
            total -= sum(sims[j] - log(sum(map(exp, kept))) for j in positives) / len(positives) / len(rows) / 2
    return total


def test_both_modes_with_and_without_hard_negatives(spark):
    rng = np.random.default_rng(6)
    vectors = lambda n: rng.normal(size=(n, 4)).tolist()
    rows = [(g, k, *vectors(2), int(rng.integers(0, 3)), vectors(3) if k else None, vectors(k % 4)) for g, n in ((0, 7), (1, 1), (2, 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "g bigint, k bigint, a array<double>, b array<double>, u bigint, na array<array<double>>, nb array<array<double>>")
    for mode in ("mask_neg", "multi_positive"):
        for use in (False, True):
            out = E.graph_contrast(df, "g", "k", "a", "b", "u", mode, 0.5, *(("na", "nb") if use else ())).collect()
            assert {r.g: r.n for r in out} == {0: 7, 1: 1, 2: 5}
            for r in out:
                assert r.loss == pytest.approx(literal([x[2:] for x in rows if x[0] == r.g], mode, 0.5, use), abs=1e-9)
    with pytest.raises(ValueError, match="unknown mode"):
        E.graph_contrast(df, "g", "k", "a", "b", "u", "other")


def test_negative_vectors(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.8, 0.2]), (4, 2, [0.0, 1.0])], "k bigint, g bigint, v array<double>")
    out = {r.k: r.negatives for r in E.negative_vectors(E.hard_negatives(v, "k", "g", "v", 2), v, "k", "v").collect()}
    assert out[1] == [[0.8, 0.2], [0.0, 1.0]] and out[4] == [[0.8, 0.2], [0.9, 0.1]]

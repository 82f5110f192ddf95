"""Optimal transport and assignment for small matrices, one matrix per group; kernels are numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def sinkhorn(cost: np.ndarray, epsilon: float = 0.1, rounds: int = 20, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
    """Entropic transport plan in the log domain; uniform marginals unless given."""
    n, m = cost.shape
    la, lb = np.log(np.maximum(a, 1e-30) if a is not None else np.full(n, 1 / n)), np.log(np.maximum(b, 1e-30) if b is not None else np.full(m, 1 / m))
    f, g, k = np.zeros(n), np.zeros(m), -cost / epsilon
    for _ in range(rounds):
        f = la - _logsumexp(k + g[None, :], 1)
        g = lb - _logsumexp(k + f[:, None], 0)
    return np.exp(k + f[:, None] + g[None, :])


def structured_sinkhorn(
    cost: np.ndarray, ga: np.ndarray, gb: np.ndarray, weight: float = 0.1, outer: int = 5, epsilon: float = 0.05, rounds: int = 20,
    a: np.ndarray | None = None, b: np.ndarray | None = None, penalty: np.ndarray | None = None, penalty_weight: float = 0.3,
) -> np.ndarray:
    """Transport whose cost grows by a penalty of unlike types, and by the gradient of mass that sends neighbours (adjacency ga) to rows of gb that are none.

    Each round adds weight * (ga M far + ga' M far') to the first cost, far being 1 - gb with a zero diagonal: a node is no stranger to itself.
    """
    if penalty is not None:
        cost = cost + penalty_weight * penalty
    far = 1.0 - gb
    np.fill_diagonal(far, 0.0)
    plan = sinkhorn(cost, epsilon, rounds, a, b)
    for _ in range(outer):
        plan = sinkhorn(cost + weight * (ga @ plan @ far + ga.T @ plan @ far.T), epsilon, rounds, a, b)
    return plan


def with_sink(similarity: np.ndarray, scale: float, b: np.ndarray | None = None, epsilon: float = 0.1, rounds: int = 20, most: float = 0.45) -> np.ndarray:
    """A plan over one more column of similarity 0, which takes scale * rows / columns of all mass, `most` at most; the other columns share the rest by b (uniform)."""
    n, m = similarity.shape
    share = min(scale * n / max(m, 1), most) if m else 0.0
    b = np.full(m, 1 / max(m, 1)) if b is None else b
    if share < 1e-8:
        return sinkhorn(1 - similarity, epsilon, rounds, None, b)
    return sinkhorn(1 - np.hstack([similarity, np.zeros((n, 1))]), epsilon, rounds, None, np.r_[b * (1 - share), share])


def region_pairs(x: np.ndarray, y: np.ndarray, compatible: np.ndarray, tau: float = 0.1, epsilon: float = 0.05, rounds: int = 20, least: float = 0.0) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(plan, pairs) of two sides' region vectors: cosine over tau, regions whose types don't go together shut out, transport, then one-to-one pairs by falling mass.

    A region that goes with no other has an empty row; a pair has a mass over 0 and of `least` or more.
    """
    n, m = len(x), len(y)
    if not n or not m:
        return np.zeros((n, m)), []
    cost = np.where(compatible, -(1 - cosine_cost(x, y)) / tau, 1e30)
    rows, cols = np.flatnonzero(compatible.any(1)), np.flatnonzero(compatible.any(0))
    plan = np.zeros((n, m))
    if len(rows):
        plan[np.ix_(rows, cols)] = sinkhorn(cost[np.ix_(rows, cols)], epsilon, rounds, np.full(len(rows), 1 / n), np.full(len(cols), 1 / m))
    plan[~compatible] = 0.0
    return plan, greedy(plan, max(least, np.nextafter(0, 1)))


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns by shortest augmenting paths; a matrix with more rows than columns is turned."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in hungarian(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j]:
            done[j] = True
            row = match[j]
            free = np.flatnonzero(~done[1:]) + 1
            now = cost[row - 1, free - 1] - u[row] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j
            j2 = free[least[free].argmin()]
            step = least[j2]
            u[match[done]] += step
            v[done] -= step
            least[~done] -= step
            j = j2
        while j:
            match[j], j = match[way[j]], way[j]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def greedy(score: np.ndarray, least: float = 0.0) -> list[tuple[int, int]]:
    """One-to-one pairs by falling score (ties: row, then column), those of `least` or more."""
    n, m = score.shape
    order = np.lexsort((np.tile(np.arange(m), n), np.repeat(np.arange(n), m), -score.ravel()))
    rows, cols, out = set(), set(), []
    for k in order:
        i, j = divmod(int(k), m)
        if score[i, j] >= least and i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.append((i, j))
    return out


def parent_tree(scores: np.ndarray, root: np.ndarray) -> list[int]:
    """Each node's best parent (n stands for the root); of a cycle the node that scores least as a root is attached to it, until there is none; one node at least is."""
    n = len(root)
    if not n:
        return []
    s = np.hstack([scores, root[:, None]]).astype(float)
    s[np.arange(n), np.arange(n)] = -1e9
    parent = s.argmax(1).tolist()
    while True:
        ring: list[int] = []
        for start in range(n):
            seen, at = [], start
            while at != n and at not in seen:
                seen.append(at)
                at = parent[at]
            if at != n:
                ring = seen[seen.index(at) :]
                break
        if not ring:
            break
        parent[min(ring, key=lambda k: (root[k], ring.index(k)))] = n
    if n not in parent:
        parent[int(root.argmax())] = n
    return parent


def tree_loss(scores: np.ndarray, root: np.ndarray, target: list[int | None]) -> float:
    """Negative log share of a tree among all rooted trees, by the determinant of a Laplacian; None leaves a node's arc out. scores[child, parent]."""
    n = len(root)
    kept = [(c, p) for c, p in enumerate(target) if p is not None and p != c]
    if not kept:
        return 0.0
    w = np.exp(np.clip(scores, -30, 30))
    np.fill_diagonal(w, 0.0)
    lap = np.diag(w.sum(1) + np.exp(np.clip(root, -30, 30))) - w.T
    return float(np.linalg.slogdet(lap)[1] - sum(root[c] if p == n else scores[c, p] for c, p in kept))


def cosine_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12), b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    return 1 - a @ b.T


def per_pair_of_sets(df: DataFrame, group: str, side: str, key: str, vector: str, kernel: Callable[..., list[tuple[int, int, float]]], mass: str | None = None, penalty: DataFrame | None = None) -> DataFrame:
    """Rows (group, a, b, value): kernel gets the vectors of side 0 and side 1 of a group, in the order of their keys. A group is one function or region pair.

    With mass (a column) or penalty (rows group, a, b, penalty; pairs without a row have 1) it gets both sides' shares of mass and the matrix, too, None for what is not given."""
    kind = dict(df.dtypes)
    none = pd.DataFrame({group: [], "a": [], "b": [], "value": []})

    def run(pdf: pd.DataFrame, costs: pd.DataFrame | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        parts = [pdf[pdf[side] == s] for s in (0, 1)]
        if not len(parts[0]) or not len(parts[1]):
            return none
        x, y = (np.stack(p[vector].map(np.asarray).tolist()).astype(float) for p in parts)
        ids = [p[key].to_numpy() for p in parts]
        more = ()
        if mass is not None or costs is not None:
            shares = [p[mass].to_numpy(float) / p[mass].sum() for p in parts] if mass is not None else (None, None)
            more = (*shares, None if costs is None else costs.set_index(["a", "b"])["penalty"].reindex(pd.MultiIndex.from_product(ids), fill_value=1.0).to_numpy(float).reshape(len(x), len(y)))
        rows = kernel(x, y, *more)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(rows), "a": [ids[0][i] for i, _, _ in rows], "b": [ids[1][j] for _, j, _ in rows], "value": [v for _, _, v in rows]})

    rows = df.select(group, side, key, vector, *([mass] if mass else []))
    schema = f"{group} {kind[group]}, a {kind[key]}, b {kind[key]}, value double"
    if penalty is None:
        return rows.groupBy(group).applyInPandas(lambda pdf: run(pdf), schema)
    own = penalty.select(F.col(group).alias("_group"), "a", "b", "penalty").groupBy("_group")  # both tables may come from one
    return rows.groupBy(group).cogroup(own).applyInPandas(lambda pdf, costs: run(pdf, costs), schema)

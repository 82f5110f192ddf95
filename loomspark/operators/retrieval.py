"""Nearest rows by inner product, and contrastive losses, over embedding columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settled

#: Rows of a block; two blocks meet in a task at a time, a chunk of queries of one with all rows of the other.
BLOCK = 2048
CHUNK = 256


#: Parts of a block's rows whose best scores bound the k-th best of all from below.
PARTS = 64
#: Times k of a query's scores that are computed one by one; where more may be among the best, as of copies, the chunk is computed again.
MANY = 16


def _least(score: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores a bound that at least k of its scores reach, if there are as many."""
    n, parts = score.shape[1], max(PARTS, 4 * k)
    if n <= k:
        return np.full(len(score), -np.inf)
    if n >= 4 * parts:  # the best scores of k parts are k scores
        score = score[:, : n // parts * parts].reshape(len(score), parts, n // parts).max(2)
        n = parts
    return np.partition(score, n - k, axis=1)[:, n - k]


def _product(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of a group's queries (role 0) and rows (role 1) the k best rows of other groups for each query.

    Single precision says which scores may be among the best, by the most that it can be wrong; only these are computed in double precision. Where it can't hold the vectors, or says too little, all is computed in double precision.
    """

    def run(table: pa.Table) -> pa.Table:
        role = np.asarray(table["role"])
        code = np.asarray(table["g"].combine_chunks().dictionary_encode().indices.fill_null(-1))
        keys, groups, vectors = [], [], []
        for r in (0, 1):
            at = np.flatnonzero(role == r)
            at = at[np.argsort(code[at], kind="stable")]  # what a query may not meet stands together
            side = table.take(pa.array(at))
            keys.append(np.asarray(side["key"]))
            groups.append(code[at])
            v = side["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            vectors.append(v.reshape(len(keys[-1]), -1) if len(keys[-1]) else v)
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        n = len(keys[1])
        ways = []  # vectors by their precision, and by how much a query's scores may be wrong there
        if len(keys[0]) and n:
            with np.errstate(over="ignore", invalid="ignore"):
                size = [np.sqrt((v * v).sum(1)) for v in vectors]
                most = [x.max() for x in size]
                if np.isfinite(most).all() and max(*most, most[0] * most[1]) < 1e30:
                    ways.append(([v.astype(np.float32) for v in vectors], 2.0**-21 * (vectors[0].shape[1] + 8) * size[0] * most[1]))
            ways.append((vectors, np.zeros(len(keys[0]))))
        step = max(1, min(CHUNK, CHUNK * 4 * BLOCK // max(1, n)))
        for a in range(0, len(keys[0]) if n else 0, step):
            z = a + step
            g, first, many = np.unique(groups[0][a:z], return_index=True, return_counts=True)
            own = list(zip(first, first + many, np.searchsorted(groups[1], g), np.searchsorted(groups[1], g, "right"), strict=True))
            for (x, y), wrong in ways:
                with np.errstate(over="ignore", invalid="ignore"):
                    score = x[a:z] @ y.T
                if not np.isfinite(score.sum()):
                    score[~np.isfinite(score)] = -np.inf
                for q0, q1, c0, c1 in own:
                    score[q0:q1, c0:c1] = -np.inf
                # what may be among the k best once scores are rounded; only these are rounded and sorted
                least = (_least(score, k).astype(float) - wrong[a:z] - 2e-6).astype(score.dtype)
                at = np.flatnonzero((score >= np.nextafter(least, score.dtype.type(-np.inf))[:, None]) & (score > -np.inf))
                if len(at) <= MANY * k * len(score):
                    break
            q, c = np.divmod(at, n)
            value = np.round(score[q, c] if x is vectors[0] else np.einsum("ij,ij->i", vectors[0][a + q], vectors[1][c]), 6)
            other = keys[1][c]
            order = np.lexsort((other, -value, q))
            q, other, value = q[order], other[order], value[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append((keys[0][a:z][q[first]], other[first], value[first]))
        return pa.table(dict(zip(("key", "other", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    """(key, rank, other, score) of the k best of found (key, other, score); reduced in 64 parts of a key first, so what one task gathers grows with a 64th of the blocks."""
    order = F.struct((-F.col("score")).alias("s"), "other")
    first = found.groupBy("key", F.pmod(F.xxhash64("other"), F.lit(64))).agg(F.slice(F.sort_array(F.collect_set(order)), 1, k).alias("t"))
    top = first.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("t"))), 1, k).alias("t"))
    return top.select("key", F.posexplode("t").alias("rank", "x")).select(F.col("key").alias(key), (F.col("rank") + 1).cast("long").alias("rank"), "x.other", F.round(-F.col("x.s"), 6).alias("score"))


_FOUND = "key bigint, other bigint, score double"


def hard_negatives(df: DataFrame, key: str, group: str, vector: str, k: int) -> DataFrame:
    """For every row the k rows of other groups with the largest inner product (ties: smaller key): (key, rank, other, score).

    Exact: rows are dealt by hash into blocks of about BLOCK, of large tables into a dozen up to sixteen times that size, and every pair of blocks is one task's product, of which only k rows per query
    leave the task. The work is that of all scores, and every vector is copied to as many tasks as there are blocks; see `hard_negatives_indexed` for large banks.
    """
    rows = df.select(F.col(key).alias("key"), F.col(group).alias("g"), F.col(vector).alias("v"))
    size = rows.count()
    n = max(1, -(-size // min(16 * BLOCK, max(BLOCK, size // 12))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    left = rows.withColumn("other_block", F.explode(every)).withColumn("role", F.lit(0))
    right = rows.withColumnRenamed("block", "other_block").withColumn("block", F.explode(every)).withColumn("role", F.lit(1))
    near = left.unionByName(right).select("block", "other_block", "role", "key", "g", "v").groupBy("block", "other_block").applyInArrow(_product(k), _FOUND)
    return _best(near, key, k)


def centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit vectors in the middle of n cells of a sample, by spherical k-means; a cell that runs empty takes a random row."""
    rng = np.random.default_rng(seed)
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def hard_negatives_indexed(df: DataFrame, key: str, group: str, vector: str, k: int, probes: int = 8, sample: int = 20_000, cells: int | None = None) -> DataFrame:
    """The same by an index: every row lies in the cell of its nearest centroid, and each row looks into its `probes` nearest cells.

    Centroids (about the root of the number of rows, 4,096 at most) are fitted on the `sample` rows with the smallest hashes; all rows are indexed and all are queries. A cell of over
    BLOCK rows is cut into parts, and so are the queries that look into it, so a group has 2 * BLOCK rows or so. tests hold the recall against the exact way.
    """
    rows = df.select(F.col(key).alias("key"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    taken = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow()
    if not n:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("rank"), F.col("key").alias("other"), F.lit(0.0).alias("score"))
    middle = centroids(np.stack(taken["v"].to_pylist()), cells or max(1, min(4096, round(n**0.5))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.stack(batch["v"].to_pylist()) @ middle.T
                near = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.record_batch([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "near"])

    placed = settled(rows.mapInArrow(place, "key bigint, g " + dict(rows.dtypes)["g"] + ", v array<double>, near array<int>"))
    asked = placed.select("key", "g", "v", F.explode("near").alias("cell"))
    own = placed.select("key", "g", "v", F.get("near", F.lit(0)).alias("cell"))
    parts = lambda d, name: d.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(parts(own, "nr").join(parts(asked, "nq"), "cell"))  # a row for each cell
    part = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(sizes, "cell").select("cell", part("nq").alias("q"), every("nr").alias("r"), F.lit(0).alias("role"), "key", "g", "v")
    right = own.join(sizes, "cell").select("cell", every("nq").alias("q"), part("nr").alias("r"), F.lit(1).alias("role"), "key", "g", "v")
    return _best(left.unionByName(right).groupBy("cell", "q", "r").applyInArrow(_product(k), _FOUND), key, k)


def batch_losses(df: DataFrame, batch: str, key: str, a: str, b: str, uid: str, tau: float = 0.07) -> DataFrame:
    """Per batch (a bounded number of pairs): symmetric InfoNCE, and the same with other pairs of the same uid left out of the denominators."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        x, y = (np.stack(table[c].to_pylist()).astype(float) for c in (a, b))
        u = np.asarray(table[uid])
        s = x @ y.T / tau
        same = (u[:, None] == u[None, :]) & ~np.eye(len(u), dtype=bool)

        def loss(z: np.ndarray) -> float:
            m = z.max(1, keepdims=True)
            return float((m[:, 0] + np.log(np.exp(z - m).sum(1)) - np.diag(z)).mean())

        masked = np.where(same, -np.inf, s)
        return pa.table({batch: table[batch].slice(0, 1), "n": pa.array([len(u)], pa.int64()), "infonce": [(loss(s) + loss(s.T)) / 2], "masked": [(loss(masked) + loss(masked.T)) / 2]})

    kind = dict(df.dtypes)[batch]
    return df.select(batch, key, a, b, uid).groupBy(batch).applyInArrow(run, f"{batch} {kind}, n bigint, infonce double, masked double")


def negative_vectors(found: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, negatives): the vectors of the rows that `hard_negatives` found (key, rank, other), by rank."""
    v = vectors.select(F.col(key).alias("other"), F.col(vector).cast("array<double>").alias("_v"))
    per = found.select(key, "rank", "other").join(v, "other").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("_v").alias("v")))).alias("_n"))  # k per key
    return per.select(key, F.col("_n.v").alias("negatives"))


def graph_contrast(df: DataFrame, batch: str, key: str, a: str, b: str, uid: str, mode: str = "mask_neg", tau: float = 0.07, negatives_b: str | None = None, negatives_a: str | None = None) -> DataFrame:
    """Per batch (a bounded number of pairs) the symmetric loss of normed vectors: (batch, n, loss).

    `mask_neg` leaves other pairs of the same uid out of the denominators; in `multi_positive` all of them are positives, over whose number the log shares
    are averaged. negatives_b and negatives_a are columns of vectors (array<array<double>>, any number in a row): of side b for a row's a, of side a for its
    b; they are further columns of the denominators and never positive. A batch of one pair has 1 - cosine.
    """
    if mode not in ("mask_neg", "multi_positive"):
        raise ValueError(f"unknown mode: {mode}")
    extra = [c for c in (negatives_b, negatives_a) if c]

    def normed(numbers: pa.Array, n: int) -> np.ndarray:
        x = numbers.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def columns(anchors: np.ndarray, rows: pa.ListArray) -> np.ndarray:
        many, vectors = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), rows.flatten()
        at = np.repeat(np.arange(len(rows)), many)
        out = np.full((len(rows), many.max(initial=0)), -np.inf)
        if len(at):
            out[at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)] = (normed(vectors.flatten(), len(at)) * anchors[at]).sum(1) / tau
        return out

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        n, u = table.num_rows, np.asarray(table[uid])
        x, y = (normed(table[c].combine_chunks().flatten(), n) for c in (a, b))
        same = u[:, None] == u[None, :]
        if n == 1:
            total = float(1 - (x * y).sum())
        else:
            logits, losses = x @ y.T / tau, []
            if mode == "mask_neg":
                logits, same = np.where(same & ~np.eye(n, dtype=bool), -np.inf, logits), np.eye(n, dtype=bool)
            for z, anchors, c in ((logits, x, negatives_b), (logits.T, y, negatives_a)):
                wide = np.hstack([z, columns(anchors, table[c].combine_chunks())]) if c else z
                m = wide.max(1, keepdims=True)
                share = z - m - np.log(np.exp(wide - m).sum(1, keepdims=True))
                losses.append(-(np.where(same, share, 0.0).sum(1) / same.sum(1)).mean())
            total = float(sum(losses) / 2)
        return pa.table({batch: table[batch].slice(0, 1), "n": pa.array([n], pa.int64()), "loss": [total]})

    kind = dict(df.dtypes)[batch]
    return df.select(batch, key, a, b, uid, *extra).groupBy(batch).applyInArrow(run, f"{batch} {kind}, n bigint, loss double")



"""Language ID by error-correcting output codes over byte n-grams.

Each language gets a codeword; each bit is a linear classifier of hashed 1- to 4-grams (A-Z lower-cased, runs of non-letters of ASCII as one
space). Up to 7 languages the code holds every way to split them in two; beyond that, random balanced splits, drawn until
all pairs of codewords are far apart. A bit's value is decoded with its loss, exp(-margin), weighted by the bit's accuracy on fitting
rows it was not fitted on; the codeword of least loss wins. `score` is its softmax share and `ambiguous` says that the runner-up came close.

Cases: a null text or one without a letter is `und` with score 0 and ambiguous. Repeated rows and null ids are predicted row by row.
With no fitting rows all is `und`; with one language alone that one is predicted. Of languages whose losses are equal the first by name wins, and is ambiguous. Texts of any length are
fitted on and predicted by all of their bytes. An empty table gives an empty result. Extra columns pass through untouched in `predict`; `lang_pred`,
`score` and `ambiguous` replace columns of these names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import slices, text_bytes
from .shared import small_batches

#: Hash buckets of n-grams.
BUCKETS = 1 << 13
GRAMS = 4
#: Rows per language that the classifiers are fitted on, at most; the ones with the smallest hash of id and text.
MAX_FIT_ROWS = 600
#: Rows that are fitted on in all: with more languages each has fewer, one at least. The fit holds matrices of this many rows squared.
MAX_FIT_TOTAL = 4000
#: Bytes that are hashed at a time; longer texts add up over parts.
PART = 4 << 20
AMBIGUOUS = 0.6
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of square-rooted, normed n-gram counts for each text; whole texts, any length."""
    out = np.zeros((len(at) - 1, BUCKETS), np.float32)
    for k, (a, b) in enumerate(itertools.pairwise(at.tolist())):
        for p in range(a, b, PART):
            part = _FOLD[raw[p : min(b, p + PART + GRAMS - 1)]]
            keep = np.ones(len(part), bool)
            keep[1:] = (part[1:] != 32) | (part[:-1] != 32)
            part = part[keep].astype(np.uint32)
            h = np.zeros(len(part), np.uint32)
            for n in range(1, GRAMS + 1):
                if len(part) < n:
                    break
                h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
                out[k] += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=BUCKETS)
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-9)[:, None]
    return out


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1, one column for each binary classifier."""
    if n <= 7:
        columns = [[1, *x] for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(columns, np.int8).T.reshape(n, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.permuted(np.tile(np.where(np.arange(n) % 2, 1, -1)[:, None], bits), axis=0).astype(np.int8)
        alike = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(alike, -bits)
        least = (bits - int(alike.max())) // 2
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    trust: np.ndarray  # per bit

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share, and whether the result is ambiguous."""
        f = np.clip(x @ self.weights + self.bias, -3, 3)
        # exp(-f * code) summed over bits, by the code's sign; nothing of rows x languages x bits is made
        loss = ((np.exp(-f) * self.trust) @ (self.code > 0).T + (np.exp(f) * self.trust) @ (self.code < 0).T) / max(self.trust.sum(), 1e-9)
        share = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = share[np.arange(len(x)), best]
        return best, score, score < AMBIGUOUS


def fit(x: np.ndarray, rows: list[str], ridge: float = 0.3) -> Model | None:
    """Ridge regression of every bit on the features of the fitting rows, whose languages are `rows`, in its dual form; each bit's trust comes from two-fold fits."""
    languages = sorted(set(rows))
    if not languages:
        return None
    code = codewords(len(languages))
    place = {lang: k for k, lang in enumerate(languages)}
    number = np.array([place[lang] for lang in rows])
    y = code[number].astype(np.float64)
    balance = np.sqrt(len(rows) / (len(languages) * np.bincount(number, minlength=len(languages))))[number]
    # products of all rows, with a constant feature beside the n-grams; nothing else of the size of x is made
    gram = x @ x.T
    gram += 1
    gram = gram.astype(np.float64)
    gram *= balance[:, None]
    gram *= balance[None, :]

    def solve(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = gram[np.ix_(some, some)]
        own[np.diag_indices(len(some))] += ridge
        alpha = np.linalg.solve(own, y[some] * balance[some][:, None]) * balance[some][:, None]
        full = np.zeros((len(rows), code.shape[1]), np.float32)
        full[some] = alpha
        return x.T @ full, alpha.sum(0)

    folds = [np.arange(len(rows))[k::2] for k in range(2)]
    right = np.zeros(code.shape[1])
    for k in range(2):
        if len(folds[1 - k]):
            w, c = solve(folds[1 - k])
            right += ((x[folds[k]] @ w + c) * y[folds[k]] > 0).sum(0)
    rate = np.clip(right / len(rows), 0.51, 0.999)
    w, c = solve(np.arange(len(rows)))
    return Model(languages, code, (2 * w).astype(np.float32), (2 * c).astype(np.float32), np.log(rate / (1 - rate)))


def _predicting(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", rows=128):
                raw, at = text_bytes(part["text"])
                n = len(at) - 1
                lang, score, unsure = [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
                letters = np.concatenate([[0], np.cumsum((_FOLD[raw] != 32) & (raw < 128))])
                ok = letters[at[1:]] > letters[at[:-1]]
                for k in np.flatnonzero(~ok):
                    ok[k] = at[k + 1] > at[k] and has_letter(raw[at[k] : at[k + 1]].tobytes())
                if model and ok.any():
                    best, share, close = model.decode(features(raw, at))
                    lang = [model.languages[i] if o else UNDETERMINED for i, o in zip(best, ok, strict=True)]
                    score, unsure = np.where(ok, share, 0.0), np.where(ok, close, True)
                names = [c for c in part.schema.names]
                yield pa.record_batch([*(part[c] for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])

    return predict


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of whole texts, what is not zero of them: places (16 bits) and values (32 bits)."""
    for batch in batches:
        for part in slices(batch, "text", rows=128):
            x = features(*text_bytes(part["text"]))
            at = [np.flatnonzero(r) for r in x]
            own = [pa.array([k.astype("<u2").tobytes() for k in at], pa.binary()), pa.array([r[k].astype("<f4").tobytes() for r, k in zip(x, at, strict=True)], pa.binary())]
            yield pa.record_batch([part["lang"].cast(pa.string()), part["_h"], part["_tie"].cast(pa.string()), *own], ["lang", "_h", "_tie", "at", "x"])


def fit_sample(docs: DataFrame, per_language: int = MAX_FIT_ROWS, most_rows: int = MAX_FIT_TOTAL) -> Model | None:
    """Fit on rows with a text and a lang: of every language the rows with the smallest hashes, `per_language` at most, and fewer of each where the
    languages are so many that they would be over `most_rows` in all (but one of each at least).

    Hashes cut the candidates to little more than that number on the executors; features of their whole texts are made there, too, and sorted and sent in place of texts.
    """
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.length("text"), F.substring("text", 1, 200)), F.lit(1 << 30))
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").withColumn("_h", h)
    # hashes, not rows: a language of a few rows that stand there often would have none below its share
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("count"))
    each = max(1, min(per_language, most_rows // max(1, counts.count())))
    share = F.lit(float(1 << 30)) * (each + 6 * each**0.5 + 20) / F.col("count")
    near = rows.join(F.broadcast(counts), "lang").where(F.col("_h") <= share)
    small_batches(docs.sparkSession)
    near = near.select(F.col("lang").cast("string").alias("lang"), "_h", F.md5(F.col("text").cast("binary")).alias("_tie"), F.col("text").cast("string").alias("text"))
    near = near.mapInArrow(_featured, "lang string, _h bigint, _tie string, at binary, x binary")
    # a few hundred rows per language by construction; the window sorts, so many rows of one hash are held nowhere
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_tie"))
    found = near.withColumn("_k", first).where(F.col("_k") <= each).drop("_k").collect()  # 48 KB a row at most
    found.sort(key=lambda r: (r["lang"], r["_h"], r["_tie"]))
    x = np.zeros((len(found), BUCKETS), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], "<f4")
    return fit(x, [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    small_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "ambiguous").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return kept.mapInArrow(_predicting(model), schema)

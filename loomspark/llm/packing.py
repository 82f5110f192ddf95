"""Packing: order-preserving dynamic programming over cut points.

Documents keep their order within a partition; their ids, each document closed by `end_id`, form one stream. A sequence may end where a
document ends (free), where a sentence or line ends (SENTENCE_CUT), or, in a stretch of `length` ids without either, at a forced place
(HARD_CUT). Of all such cuts the program takes those with the least sum of padding, cut penalties and SEQUENCE_COST. Padding fills a sequence to
`length`, except that one of exactly 256, 512 or 1024 ids has none. The best start of the sequence that ends at a cut is the minimum of
f(i) + b(i) over the window of cuts at most `length` back: a monotone queue yields it in constant time, and the exact powers of two
are looked up beside it.

The stream is solved in stretches of STRETCH ids; all but the last sequences of a stretch are final, the rest goes to the next one. So
memory is bounded by a stretch and one document, nothing is shuffled, and only a partition's last sequence may be left short.

Cases: a null or empty text is the single id `end_id`. Special tokens' strings in a text are these tokens. Repeated rows and null ids are packed row by row. A very long text is encoded whole and its stretch grows with it. Of cuts that cost the same the one whose sequence begins
earliest is taken. Extra columns are ignored. An
empty table has no sequences.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .bpe import default_path, encoder
from .shared import small_batches

LENGTH, END_ID = 2048, 1
SENTENCE_CUT, HARD_CUT, SEQUENCE_COST = 8, 64, 2
STRETCH = 64 * LENGTH
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end (0 and the stream's end among them) and the penalty of each."""
    soft = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
    places = np.unique(np.concatenate([[0], soft, doc_ends, [len(ids)]]))
    gaps = np.flatnonzero(np.diff(places) > length)
    forced = [np.arange(places[g] + length, places[g + 1], length) for g in gaps]
    if forced:
        places = np.unique(np.concatenate([places, *forced]))
    cost = np.full(len(places), HARD_CUT, np.int64)
    cost[np.searchsorted(places, soft)] = SENTENCE_CUT
    cost[np.searchsorted(places, doc_ends)] = 0
    cost[0] = cost[-1] = 0  # the stream's end is no cut: it goes on in the next stretch, or is over
    return places, cost


def padding(n: int, length: int = LENGTH) -> int:
    return 0 if n & (n - 1) == 0 and 256 <= n <= length else length - n


def best_cuts(places: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cheapest cuts from places[0] to places[-1], both included. Neighbouring places are at most `length` apart."""
    b, c = places.tolist(), cost.tolist()
    at = dict(zip(b, range(len(b)), strict=True))
    exact = [n for n in (256, 512, 1024) if n < length]
    f, back = [0] * len(b), [0] * len(b)
    queue: deque[tuple[int, int]] = deque([(b[0], 0)])  # (f(i) + b(i), i), growing from the front
    for j in range(1, len(b)):
        e = b[j]
        while e - b[queue[0][1]] > length:
            queue.popleft()
        g, i = queue[0]
        best = g + length - e
        for n in exact:
            if (k := at.get(e - n)) is not None and f[k] < best:
                best, i = f[k], k
        f[j] = best = best + c[j] + SEQUENCE_COST
        back[j] = i
        best += e
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, j))
    cuts, j = [b[-1]], len(b) - 1
    while j:
        j = back[j]
        cuts.append(b[j])
    return cuts[::-1]


class _Stream:
    """Documents of one partition, turned into pieces of sequences."""

    def __init__(self, ends_sentence: np.ndarray, length: int, first_sequence: int):
        self.ends, self.length, self.sequence = ends_sentence, length, first_sequence
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, its document's ids, ids
        self.n = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append((doc_id, 0, len(ids), ids))
        self.n += len(ids)

    def solve(self, last: bool) -> None:
        if not self.n:
            return
        ids = np.concatenate([p[3] for p in self.parts])
        ends = np.cumsum([len(p[3]) for p in self.parts])
        cuts = best_cuts(*boundaries(ids, ends, self.ends, self.length), self.length)
        if not last:
            cuts = cuts[:-2]  # the last two sequences may end better with what comes
        k, done = 0, 0
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            at = a
            while at < e:
                while ends[k] <= at:
                    k += 1
                doc_id, start, total, own = self.parts[k]
                first = int(ends[k]) - len(own)
                to = min(e, int(ends[k]))
                piece = ids[at:to]
                self.out.append((doc_id, start + at - first, to - at, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, at - a))
                at = to
            self.sequence += 1
            done = e
        left = []
        for (doc_id, start, total, own), end in zip(self.parts, ends, strict=True):
            if end > done:
                skip = max(0, done - (int(end) - len(own)))
                left.append((doc_id, start + skip, total, own[skip:]))
        self.parts, self.n = left, len(ids) - done

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[]] * 7
        self.out = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _packing(path: str, length: int, end_id: int, stretch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, close = encoder(path), np.array([end_id], "<u4").tobytes()
        stream = _Stream(enc.ends_sentence(), length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    stream.add(doc_id, np.frombuffer(enc.encode(text or "") + close, "<u4"))
                    if stream.n >= stretch:
                        stream.solve(False)
                yield stream.taken()
        stream.solve(True)
        yield stream.taken()

    return pack


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, stretch: int = STRETCH) -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_packing(tokenizer or default_path(), length, end_id, stretch), SCHEMA)

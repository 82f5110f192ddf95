"""Views of Arrow string columns as bytes, and hashes of their words, for operators that work on batches.

Cases: a null text is empty; a text without words has no hashes. Long texts are hashed in parts, also words longer than a part. Equal texts have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `rows` rows whose texts have about `most` bytes; a longer text is a part of its own."""
    n = np.cumsum(np.nan_to_num(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(n, (n[start - 1] if start else 0) + most, "right")))
        end = min(end, start + rows)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that are hashed at a time: working arrays have 8 bytes for each.
_PART = 1 << 20
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """_BASE to the power of 0, 1, ... and its inverse likewise, for one part; made once per worker."""
    if not _tables:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(_PART + 1, base, np.uint64)
            x[0] = 1
            _tables.append(np.multiply.accumulate(x))
    return _tables


def _hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end) of a part of _PART bytes at most."""
    power, back = _powers()
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts])


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of each text, A-Z lower-cased, and n + 1 offsets of the texts' words.

    A word's hash is a polynomial over its bytes from its own start, so it does not depend on where the word stands.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inner = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True  # a text's end is a word's end
    starts = np.flatnonzero(inner & (edge[:-1] | np.concatenate([[True], ~inner[:-1]])))
    ends = np.flatnonzero(inner & (edge[1:] | np.concatenate([~inner[1:], [True]]))) + 1
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + _PART, "right")))
        a, b = int(starts[k]), int(ends[to - 1])
        if b - a <= _PART:
            out[k:to] = _hashes(raw[a:b], starts[k:to] - a, ends[k:to] - a)
        else:  # one word longer than a part: its parts' hashes are chained
            h = np.zeros(1, np.uint64)
            for p in range(a, b, _PART):
                q = min(b, p + _PART)
                h = mix(h * np.uint64(_BASE) + _hashes(raw[p:q], np.array([0]), np.array([q - p])))
            out[k] = h[0]
        k = to
    return out, np.searchsorted(starts, at).astype(np.int64)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, repeats included, and the text of each; a text of fewer words has one window of all."""
    counts = np.diff(at)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n)
    first = at[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    size = np.minimum(counts, k)[doc]
    out = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        more = mix(padded[first + j] + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))
        out = np.where(j < size, mix(out * np.uint64(_BASE) + more), out) if (size < k).any() else mix(out * np.uint64(_BASE) + more)
    return out, doc

"""Fill-in-middle texts: a table-driven byte DFA finds units and sentinels in one scan, a second pass locates the cuts.

A unit is a run of letters A-Z, a-z or one other code point. The automaton runs over UTF-8 bytes: its states are the nodes of the sentinels' trie (with failure links) times whether
the last byte was a letter, and a transition emits whether a unit begins, whether a code point begins (bytes 0x80 to 0xBF continue one) and whether a sentinel ends. As no
state depends on more bytes than the longest sentinel has, a block of bytes is run by looking up the table for all its places at once, that many times.

The first pass keeps counts alone: units and code points up to each block and each text. A cut after k units is then a rank in the whole sequence of units; the second pass
runs the automaton again over the blocks that hold cuts (over none again, if all texts fit in one block) and reads places and code points off. Memory is bounded by a block
and the longest text.

The cuts of a text depend on `seed` and its doc_id alone: h1 to h4 are the first four 8-digit groups of the SHA-256 of `seed:doc_id`.

Cases: a null or empty text is plain and has no units, as is a text that holds a sentinel, and those that the third number leaves so (100 - `changed` of 100). A null doc_id is hashed as the empty string. Repeated rows give
repeated rows; cuts may coincide, so any of the three parts may be empty. Very long texts are scanned in blocks. Columns other than `text` pass; those with names of the result are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import slices, text_bytes
from .shared import small_batches

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts how many are changed, and of these how many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes that the automaton scans at a time.
BLOCK = 1 << 20
UNIT, POINT, SENTINEL = 1, 2, 4
RESULT = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


@cache
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray, int]:
    """(next state, emission) by state * 256 + byte, and how many bytes a state may depend on. State 0 is a text's beginning."""
    words = [s.encode() for s in sentinels]
    if not all(words):
        raise ValueError("a sentinel is empty")
    nodes = sorted({w[:k] for w in words for k in range(len(w) + 1)}, key=lambda x: (len(x), x))
    at = {x: k for k, x in enumerate(nodes)}
    if len(nodes) > 127:
        raise ValueError("the sentinels are too long for 16-bit states")
    step, emit = np.zeros((2 * len(nodes), 256), np.uint16), np.zeros((2 * len(nodes), 256), np.uint8)
    for node in nodes:
        for byte in range(256):
            seen = node + bytes([byte])
            longest = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in at)
            letter, continues = 65 <= byte & ~32 <= 90, 128 <= byte < 192
            for run in (0, 1):
                step[2 * at[node] + run, byte] = 2 * at[longest] + letter
                begins = not (run if letter else continues)
                emit[2 * at[node] + run, byte] = UNIT * begins + POINT * (not continues) + SENTINEL * any(seen.endswith(w) for w in words)
    return step.ravel(), emit.ravel(), max(map(len, words)) - 1 or 1


def emitted(raw: np.ndarray, at: np.ndarray, a: int, b: int, sentinels: tuple[str, ...] = SENTINELS) -> np.ndarray:
    """What the automaton emits at the bytes [a, b) of texts that begin at `at`."""
    step, emit, back = automaton(sentinels)
    begins = at[np.searchsorted(at, a - back) : np.searchsorted(at, b)] - a
    state = np.zeros(b - a, np.uint16)
    for lag in range(back, 0, -1):
        seen = raw[max(0, a - lag) : b - lag] if b > lag else raw[:0]
        now = state[b - a - len(seen) :]
        now[:] = step[(now << np.uint16(8)) | seen]
        for k in range(lag):  # a text's first bytes have no byte so far back
            state[(begins + k)[(begins + k >= 0) & (begins + k < b - a)]] = 0
    return emit[(state << np.uint16(8)) | raw[a:b]]


class Scan:
    """Counts of the first pass over texts (bytes, offsets), and the second pass."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, sentinels: tuple[str, ...] = SENTINELS, block: int = BLOCK):
        self.raw, self.at, self.sentinels = raw, at, sentinels
        self.edges = np.append(np.arange(0, len(raw), block), len(raw))
        self.units, self.points = np.zeros(len(self.edges), np.int64), np.zeros(len(self.edges), np.int64)  # up to each edge
        self.unit_at, self.point_at = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)  # up to each text
        self.marked = np.zeros(len(at) - 1, bool)
        self.kept: tuple[int, np.ndarray] | None = None
        for k in range(len(self.edges) - 1):
            e = self.block(k)
            a, b = self.edges[k], self.edges[k + 1]
            own = slice(np.searchsorted(at, a, "right"), np.searchsorted(at, b, "right"))
            for bit, total, each in ((UNIT, self.units, self.unit_at), (POINT, self.points, self.point_at)):
                count = np.cumsum((e & bit) != 0)
                total[k + 1] = total[k] + count[-1]
                each[own] = total[k] + count[at[own] - a - 1]
            self.marked[np.searchsorted(at, a + np.flatnonzero(e & SENTINEL), "right") - 1] = True

    def block(self, k: int) -> np.ndarray:
        if self.kept is None or self.kept[0] != k:
            self.kept = k, emitted(self.raw, self.at, int(self.edges[k]), int(self.edges[k + 1]), self.sentinels)
        return self.kept[1]

    def cuts(self, text: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places, and code points from the text's beginning, where `after` units of these texts end."""
        place, points = self.at[text + 1].copy(), self.point_at[text + 1].copy()
        rank = self.unit_at[text] + after
        inner = rank < self.unit_at[text + 1]  # else the cut is the text's end
        of = np.searchsorted(self.units, rank, "right") - 1
        for k in np.unique(of[inner]).tolist():
            own = inner & (of == k)
            e = self.block(k)
            found = np.flatnonzero(e & UNIT)[rank[own] - self.units[k]]
            place[own] = self.edges[k] + found
            points[own] = self.points[k] + np.concatenate([[0], np.cumsum((e & POINT) != 0)])[found]
        return place, points - self.point_at[text]


def draws(doc_id: object, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))


def arranged(part: pa.RecordBatch, seed: int, sentinels: tuple[str, ...], changed: int, suffix_first: int, block: int = BLOCK) -> dict[str, pa.Array]:
    raw, at = text_bytes(part["text"])
    scan = Scan(raw, at, sentinels, block)
    n = np.diff(scan.unit_at)
    h = np.array([draws(x, seed) for x in part["doc_id"].to_pylist()], np.int64).reshape(-1, 4)
    plain = (n == 0) | scan.marked | (h[:, 2] % 100 >= changed)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < suffix_first, "spm", "psm"))
    cut = h[:, :2] % (n + 1)[:, None]
    rows = np.flatnonzero(~plain)
    (first, prefix), (last, both) = (scan.cuts(rows, f(cut, axis=1)[rows]) for f in (np.min, np.max))
    data, (p, s, m) = raw.tobytes(), (x.encode() for x in sentinels)
    output = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for k, x, y in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True):
        a, b = int(at[k]), int(at[k + 1])
        front, middle, rear = data[a:x], data[x:y], data[y:b]
        output[k] = b"".join((p, front, s, rear, m, middle) if form[k] == "psm" else (s, rear, p, front, m, middle))
    chars = np.zeros((2, len(n)), np.int64)
    chars[:, rows] = prefix, both - prefix
    text = pa.array(output, pa.large_binary()).cast(pa.large_string())
    return {"n": pa.array(n), "form": pa.array(form.astype(object), pa.string()), "prefix_chars": pa.array(chars[0], mask=plain), "middle_chars": pa.array(chars[1], mask=plain), "output": text}


def _arranging(names: list[str], *how: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = arranged(part, *how)
                found["output"] = found["output"].cast(part.schema.field("text").type)
                yield pa.record_batch([*(part[c] for c in names), *found.values()], [*names, *found])

    return arrange


def fill_in_middle(docs: DataFrame, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per row: doc_id and what else passes, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output, the text in that form."""
    small_batches(docs.sparkSession)
    passing = [c for c in docs.columns if c.lower() not in {*RESULT, "text", "doc_id"}]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`") for c in passing), F.col("text").cast("string").alias("text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField(k, v) for k, v in RESULT.items()])
    return rows.mapInArrow(_arranging(["doc_id", *passing], seed, tuple(sentinels), changed, suffix_first), schema)


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from output and form alone. Parts hold no sentinel, and none can arise where a part meets one of those that stand between parts if, as here,
    the first and last characters of sentinels stand nowhere else in them."""
    part = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))

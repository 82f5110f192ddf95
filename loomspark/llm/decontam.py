"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

A window holds WINDOW consecutive words of an item (all of them, if it has fewer). The words of the items are ordered by rarity in the
whole corpus, which a first pass over all documents counts. As a window must be contained whole, its rarest word alone is a necessary
prefix: only places of that word are joined, at the offset it has in the window. A place must leave room before and behind (positional
bound) and the document must have as many words (length bound); then a hash of the place's words finds windows, and their words are compared. A place is looked up once for each
offset and length, however many windows share the word, so a very common word stays linear. Each different window is listed once, with the items that have it: places are verified
against it once, and only a text's different windows are turned into items, so items that repeat a phrase do not multiply with the places where it stands.

Items are taken in blocks of BLOCK_WORDS words at most. A block's index holds its different words, a number for each of its words, four numbers for each different window and one for each item of it (some 40 bytes a word), and
is all that is sent to the executors, so its size is bounded. A benchmark of several blocks takes a pass for each; passes after the first
write a row for each text that they hit, by the text's digest, and these are joined at the end: texts are neither shuffled nor written.

Cases: null or empty texts have no words, no windows and no hits. Repeated documents and null ids are worked on row by row; repeated
item_ids count once, an item without an id marks hits but is not counted. Of ties any order gives the same rows; very long texts are read whole. An empty table gives an
empty result, an empty benchmark no hits. Extra columns pass; `n_words`, `spans`, `items` and the result's columns replace columns of these names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import mix, slices
from .shared import small_batches, unused, written

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: UTF-8 bytes beyond ASCII all belong to words.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return _WORDS.findall(text.translate(_LOWER)) if text else []


def _counting(vocabulary: set[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"].cast(pa.binary()):
                found.update(filter(vocabulary.__contains__, words(text.as_py())))
        yield pa.record_batch({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    return count


#: Odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the power of 0 .. n."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n + 1, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _hashes(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, start + size) of ids, independent of where they stand."""
    power, back = _powers(len(ids))
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(7)) * power[: len(ids)], out=total[1:])
    return (total[start + size] - total[start]) * back[start]


@dataclass
class Index:
    """A block of items: its words by number, its different windows by the hash of their words, each with the items that have it, and the places at which a prefix word stands in windows."""

    number: dict[bytes, int]
    flat: np.ndarray  # the items' words, one item behind the other
    names: list[str | None]
    hash: np.ndarray  # of each different window, rising; start in flat and size of each
    start: np.ndarray
    size: np.ndarray
    begin: np.ndarray  # by window, where its items begin in the next
    item: np.ndarray
    first: np.ndarray  # by word, where its (offset, length) pairs begin in the next two
    offset: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], rarity: dict[bytes, int], size: int) -> Index:
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for _, text in items for w in text], np.int32)
        n = np.array([len(text) for _, text in items], np.int64)
        windows = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), windows)
        begin = np.cumsum(n) - n
        start = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        length = np.minimum(n, size)[item]
        h = _hashes(flat, start, length)
        order = np.lexsort((item, length, h))
        start, length, item, h = start[order], length[order], item[order], h[order]
        # a window is new unless it has the words of the one before (of two windows that share a hash by chance either may be listed again, with the items of that entry)
        new = np.ones(len(h), bool)
        alike = np.flatnonzero((h[1:] == h[:-1]) & (length[1:] == length[:-1])) + 1
        same = np.ones(len(alike), bool)
        for k in range(size):
            inside = k < length[alike]
            same[inside] &= flat[start[alike[inside]] + k] == flat[start[alike[inside] - 1] + k]
        new[alike[same]] = False
        again = np.zeros(len(h), bool)
        again[1:] = ~new[1:] & (item[1:] == item[:-1])  # an item that has the window several times
        at = np.cumsum(new)[~again] - 1
        item = item[~again]
        start, length, h = start[new], length[new], h[new]
        begin = np.searchsorted(at, np.arange(len(h) + 1))
        # rank of each word by rarity, then by the word itself
        words = list(number)
        rank = np.empty(len(words), np.int32)
        rank[sorted(range(len(words)), key=lambda k: (rarity.get(words[k], 0), words[k]))] = np.arange(len(words), dtype=np.int32)
        at = np.full((len(start), size), np.iinfo(np.int32).max, np.int32)
        for k in range(size):
            ok = k < length
            at[ok, k] = rank[flat[start[ok] + k]]
        best = at.argmin(1) if len(start) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([flat[start + best], best, length], 1), axis=0) if len(start) else np.zeros((0, 3), np.int64)
        first = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        return cls(number, flat, [i for i, _ in items], h, start, length, begin, item, first, pairs[:, 1], pairs[:, 2])

    def matches(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, size, window) of every place where a window stands in texts that stand one behind the other, texts rising: ids with -1 for words that no item has, ends of
        the texts. As windows differ, a place is verified once, however many items have its window."""
        known = np.flatnonzero(ids >= 0)
        count = self.first[ids[known] + 1] - self.first[ids[known]]
        place = np.repeat(known, count)
        pair = np.repeat(self.first[ids[known]], count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        start, size = place - self.offset[pair], self.length[pair]
        text = np.searchsorted(ends, place, "right")
        ok = (start >= np.concatenate([[0], ends])[text]) & (start + size <= ends[text])
        text, start, size = text[ok], start[ok], size[ok]
        h = _hashes(ids, start, size) if len(start) else np.zeros(0, np.uint64)
        low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        count = high - low
        here = np.repeat(np.arange(len(start)), count)
        window = np.repeat(low, count) + np.arange(len(here)) - np.repeat(np.cumsum(count) - count, count)
        text, start, size = text[here], start[here], size[here]
        same = self.size[window] == size
        for k in range(int(size.max()) if len(size) else 0):
            inside = same & (k < size)
            same[inside] = ids[start[inside] + k] == self.flat[self.start[window[inside]] + k]
        return text[same], start[same], size[same], window[same]

    def items_of(self, windows: np.ndarray) -> list[str]:
        """Ids of the items that have one of these windows, as sorted strings; items without an id have none."""
        found = np.zeros(len(self.names), bool)
        for w in np.unique(windows).tolist():
            found[self.item[self.begin[w] : self.begin[w + 1]]] = True
        return sorted({x for i in np.flatnonzero(found).tolist() if (x := self.names[i]) is not None})


def merged(spans: list[list[int]]) -> list[int]:
    out: list[int] = []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _found(index: Index, texts: list[bytes | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Of each text its number of words, merged hit spans (start, end, start, end ...; ends outside) and the ids of the items found."""
    number = index.number
    parts = [[number.get(w, -1) for w in words(t)] for t in texts]
    n = [len(p) for p in parts]
    ends = np.cumsum(n)
    text, start, size, window = index.matches(np.fromiter((x for p in parts for x in p), np.int64, int(ends[-1]) if n else 0), ends)
    spans: list[list[int]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    for k in np.unique(text).tolist():
        own, begin = slice(edges[k], edges[k + 1]), int(ends[k]) - n[k]
        where = np.unique(np.stack([start[own] - begin, start[own] - begin + size[own]], 1), axis=0)
        spans[k] = merged(where.tolist())
        items[k] = index.items_of(window[own])
    return n, spans, items


def _matching(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add n_words, spans and items to all rows."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, spans, items = _found(index, part["text"].cast(pa.binary()).to_pylist())
                own = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.record_batch([*own, *part.columns], ["n_words", "spans", "items", *part.schema.names])

    return match


def _hitting(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digest, spans and items of the texts that are hit."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, spans, items = _found(index, part["text"].cast(pa.binary()).to_pylist())
                hit = [k for k, x in enumerate(spans) if x]
                yield pa.record_batch([part["digest"].take(pa.array(hit, pa.int64())), pa.array([spans[k] for k in hit], pa.list_(pa.int64())), pa.array([items[k] for k in hit], pa.list_(pa.string()))], ["digest", "spans", "items"])

    return match


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        w = words(bytes(row["text"])) if row["text"] is not None else []
        block.append((row["item"], w))
        n += len(w)
        if n >= block_words:
            yield block
            block, n = [], 0
    yield block


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary"))

#: Spans (start, end, ...) of several passes as one merged list.
_MERGE = """flatten(transform(aggregate(array_sort(flatten(transform({0}, s -> transform(sequence(1, size(s) DIV 2), i -> struct(s[2 * i - 2] AS a, s[2 * i - 1] AS b))))), CAST(array() AS array<struct<a: bigint, b: bigint>>),
    (acc, x) -> CASE WHEN size(acc) > 0 AND x.a <= element_at(acc, -1).b THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).a AS a, greatest(element_at(acc, -1).b, x.b) AS b))) ELSE concat(acc, array(x)) END), x -> array(x.a, x.b)))"""


def contained_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of docs (text must be one) with n_words, spans (hit words as start, end, ...) and items (found item ids, as strings)."""
    small_batches(docs.sparkSession)
    rest = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in ("n_words", "spans", "items")])
    rest = rest.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), *rest.schema.fields])
    out, more = None, []
    for block in item_blocks(benchmark, block_words):
        vocabulary = {w for _, text in block for w in text}
        counted = rest.select("text").mapInArrow(_counting(vocabulary), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        rarity = {bytes(r["word"]): r["n"] for r in counted.collect()} if vocabulary else {}  # as many rows as the block has words, at most
        index = Index.of(block, rarity, window)
        if out is None:
            out = rest.mapInArrow(_matching(index), schema)
        else:
            hits = rest.select(_digest().alias("digest"), "text").mapInArrow(_hitting(index), "digest string, spans array<bigint>, items array<string>")
            more.append(written(hits.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "decontam"))
    if not more:
        return out
    every = more[0]
    for m in more[1:]:
        every = every.unionByName(m)
    own, key, some, ids = (unused(out, f"hit {x}") for x in ("text", "digest", "spans", "items"))
    hits = written(every.groupBy("digest").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")), "decontam")  # a row for each block at most
    named = out.withColumn(own, _digest()).join(hits.toDF(key, some, ids), F.col(own) == F.col(key), "left")
    spans = F.filter(F.concat(F.array("spans"), F.coalesce(some, F.array().cast("array<array<bigint>>"))), lambda s: F.size(s) > 0)
    items = F.concat(F.array("items"), F.coalesce(ids, F.array().cast("array<array<string>>")))
    both = named.withColumns({some: spans, ids: items})
    merged_spans = F.when(F.size(some) > 0, F.expr(_MERGE.format(f"`{some}`"))).otherwise(F.array().cast("array<bigint>"))
    return both.withColumns({"spans": merged_spans, "items": F.array_sort(F.array_distinct(F.flatten(ids)))}).select(*[F.col(f"`{c}`") for c in out.columns])


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, contaminated, and the spans and items they come from."""
    own = ["n_hit", "n_items", "items_sha256", "contaminated"]
    found = contained_windows(docs.drop(*own), benchmark, window, block_words)
    return found.withColumns(
        {
            "n_hit": F.expr("aggregate(spans, 0L, (s, x) -> x - s)"),  # start, end, ...: an alternating sum
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256),
            "contaminated": F.size("spans") > 0,
        }
    )

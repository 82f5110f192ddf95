"""Cross-tokenizer alignment: id-striped dense count matrices of overlapping tokens, and documents scored by them.

A text is encoded by a byte-level BPE file (A) and a sentencepiece model (B); byte offsets where tokens of both end cut it into groups, and each A and B token whose
byte ranges overlap are a link. The links of the whole corpus fill a matrix of counts, a row for each B id and a column for each A id.

1. The matrix is dealt by B id into STRIPES dense blocks (B id modulo STRIPES). Tasks reduce the links of their texts to counts of id pairs first; these are dealt by stripe and
   salt, added into a dense block with np.add.at, and the few partial blocks of a stripe are added in the same way. A block has (B ids / STRIPES) x (A ids) counts, whatever
   the corpus (100 MB here); what is not zero is written.
2. Row maxima of a block give each B id's highest count. The links of slabs of documents, one row for each slab and stripe, are dealt by stripe and salt to where the stripe's
   block is read first, so a task holds one block and one slab's links at a time. A stripe of more than GROUP links is dealt to more salts, each with a copy of its block.
3. The scores of a slab's documents, one array for each stripe, are added up slab by slab.

Texts are encoded once: links are written (a document's equal ones once, by their stripe) with the counts of each task beside them, and read again for the scores.

Both encoders begin a new token at a single space between other characters (for B this is checked on the vocabulary), so links and groups never reach over such a space. The words
between are aligned once for each worker and looked up from then on; a table of words is bounded and begins anew when it is full.

Cases: texts that are null or empty, and texts whose tokens' bytes are not the space and the text again (those that hold U+2581, for one), have no tokens: zeros, and '' for the digest.
Strings of special tokens are plain text. Ties for the highest count are all best. Repeated rows and null ids are scored row by row, and their links are counted for each row.
Very long texts are encoded word by word; a long word is aligned by itself. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .bpe import default_path, encoder
from .shared import small_batches, written

STRIPES = 128
#: Links of a stripe that one group of the scoring stage takes; salts of a stripe's counts.
GROUP, SALTS = 1 << 25, 16
#: Characters and documents of a slab at most (but for one longer text).
SLAB, SLAB_DOCS = 4 << 20, 1 << 15
#: Words and links that a table holds before it begins anew, and the longest word that is looked up.
MAX_WORDS, MAX_LINKS, MAX_LENGTH = 150_000, 2_000_000, 64
#: New words that are encoded at a time.
TOGETHER = 256
_WORD_START = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    # byte-level files write each byte as a printable character: itself, or one from U+0100 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["id"]: t["content"].encode() for t in file.get("added_tokens", [])}
    vocab = {k: bytes(byte[c] for c in token) for token, k in file["model"]["vocab"].items() if k not in special} | special
    return [vocab.get(k, b"") for k in range(max(vocab) + 1)]


class Pair:
    """Both encoders, and a table of words with their tokens and links."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.b = encoder(a, special=False), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_bytes = byte_tokens(a)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        self.shown = [f"{k}{c}".encode() for k in range(max(len(self.a_bytes), len(self.b_bytes))) for c in ",|;"]
        self.shown_sizes = np.array([len(t) for t in self.shown], np.int64)
        self.by_words = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # of each word; None where the bytes are not those of the text
        self.sizes = array("q")  # n_a, n_b, n_groups, n_links of each word
        self.links = array("I"), array("I")  # A ids, B ids

    @property
    def full(self) -> bool:
        return len(self.groups) > MAX_WORDS or len(self.links[0]) > MAX_LINKS

    def add(self, words: list[str]) -> list[int]:
        """Align new words (each with a space before it); their numbers. Words without white space at an end are encoded many at a time, one behind the other."""
        plain = [w for w in words if not (w[:1].isspace() or w[-1:].isspace())] if self.by_words else []
        number = {}
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            if self._together(some):
                number.update(zip(some, range(len(self.groups) - len(some), len(self.groups)), strict=True))
        for w in words:
            if w not in number:
                number[w] = len(self.groups)
                if not self._together([w]):
                    self.groups.append(None)
                    self.sizes.extend((0, 0, 0, 0))
        return [number[w] for w in words]

    def _together(self, words: list[str]) -> bool:
        """Align words that stand one behind the other; nothing is done if the bytes of either side's tokens are not theirs."""
        text = " " + " ".join(words)
        raw = text.encode()
        x, y = np.frombuffer(self.a.encode(text), "<u4").astype(np.int64), np.array(self.b.encode(text[1:]), np.int64)
        if any(b"".join(map(t.__getitem__, v.tolist())) != raw for t, v in ((self.a_bytes, x), (self.b_bytes, y))):
            return False
        at, bt = np.cumsum(self.a_sizes[x]), np.cumsum(self.b_sizes[y])
        # at each byte where a token ends: 1 for A, 2 for B, 3 for both; up to there one token of each side stands beside the other
        mark = np.zeros(len(raw) + 1, np.uint8)
        mark[at] = 1
        mark[bt] |= 2
        ends = np.flatnonzero(mark)
        kind = mark[ends]
        i, j = (np.cumsum(kind & bit != 0) - (kind & bit != 0) for bit in (1, 2))
        of_a, of_b = self.links
        of_a.frombytes(x[i].astype(np.uint32).tobytes())
        of_b.frombytes(y[j].astype(np.uint32).tobytes())
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        group_ends = ends[kind == 3]
        sizes = np.diff(np.stack([np.searchsorted(v, stops, "right") for v in (at, bt, group_ends, ends)]), axis=1, prepend=0)
        self.sizes.frombytes(sizes.T.astype(np.int64).tobytes())
        # the groups as text: A ids of a group, then its B ids, each with the mark that follows it
        g, h = np.searchsorted(group_ends, at), np.searchsorted(group_ends, bt)
        place_a = np.arange(len(x)) + np.searchsorted(h, g)
        place_b = np.arange(len(y)) + np.searchsorted(g, h, "right")
        shown = np.empty(len(x) + len(y), np.int64)
        shown[place_a] = 3 * x + (mark[at] == 3)
        shown[place_b] = 3 * y + 2 * (mark[bt] == 3)
        whole = b"".join(map(self.shown.__getitem__, shown.tolist()))
        cuts = np.cumsum(self.shown_sizes[shown])[np.cumsum(sizes[0] + sizes[1]) - 1].tolist()
        self.groups.extend(whole[p : q - 1] for p, q in zip([0, *cuts[:-1]], cuts, strict=True))
        return True

    def words(self, text: str) -> list[int]:
        """Numbers of the text's words; none, if it has no tokens."""
        if not text:
            return []
        parts = _WORD_START.split(text) if self.by_words else [text]
        known = self.known
        try:
            found = [known[w] for w in parts]
        except KeyError:
            new = [w for w in dict.fromkeys(parts) if w not in known]
            own = dict(zip(new, self.add(new), strict=True))
            found = [known[w] if w in known else own[w] for w in parts]
            known.update((w, k) for w, k in own.items() if len(w) <= MAX_LENGTH)
        if any(self.groups[k] is None for k in found):
            # the parts differ from the text; only if the whole does, too, it has no tokens
            found = self.add([text]) if len(parts) > 1 else found
            return [] if self.groups[found[0]] is None else found
        return found

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sizes by word, where its links begin, A ids, B ids."""
        sizes = np.array(self.sizes, np.int64).reshape(-1, 4)
        return sizes, np.concatenate([[0], np.cumsum(sizes[:, 3])]), np.array(self.links[0], np.int64), np.array(self.links[1], np.int64)


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    _pairs[a, b].clear()
    return _pairs[a, b]


def _slabs(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[int]]]]:
    """Ids and word numbers of some documents at a time. The table may begin anew only after a slab."""
    ids: list = []
    words: list[list[int]] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "text"):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                words.append(pair.words(text or ""))
                size += len(text or "")
                if size >= SLAB or len(ids) >= SLAB_DOCS:
                    yield ids, words
                    ids, words, size = [], [], 0
    if ids:
        yield ids, words


def _adding(keys: list[str], cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each run of equal keys the sum of its sparse blocks, by way of a dense one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, last = np.zeros(cells, np.int64), None
        touched: list[np.ndarray] = []

        def taken() -> pa.RecordBatch:
            # few cells are gathered from what was added, many by a look at the whole block
            at = np.unique(np.concatenate(touched)) if sum(map(len, touched)) < cells // 8 else np.flatnonzero(dense)
            touched.clear()
            values = {k: pa.array([v], pa.int32()) for k, v in zip(keys, last, strict=True)}
            found = pa.record_batch({**values, "cells": pa.array([at.astype(np.uint32).tobytes()], pa.binary()), "counts": pa.array([dense[at].tobytes()], pa.binary()), "links": pa.array([int(dense[at].sum())], pa.int64())})
            dense[at] = 0
            return found

        for batch in batches:
            for *key, at, counts in zip(*(batch[c].to_pylist() for c in (*keys, "cells", "counts")), strict=True):
                if last is not None and key != last:
                    yield taken()
                last = key
                np.add.at(dense, np.frombuffer(at, np.uint32), np.frombuffer(counts, np.int64))
                if sum(map(len, touched)) < cells // 8:
                    touched.append(np.frombuffer(at, np.uint32))
        if last is not None:
            yield taken()

    return add


def count_blocks(counts: DataFrame, a: str, b: str, stripes: int) -> DataFrame:
    """(stripe, cells, counts, links): the matrix by stripes, from counts of tasks (stripe, cells, counts). A cell is row * A ids + column, the row of a B id is its quotient by `stripes`."""
    cells = -(-_ids(b) // stripes) * len(byte_tokens(a))
    if cells >= 1 << 32:
        raise ValueError("more stripes are needed")
    pairs = counts.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(SALTS)).cast("int"))
    some = pairs.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(_adding(["stripe", "salt"], cells), "stripe int, salt int, cells binary, counts binary, links bigint")
    whole = some.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_adding(["stripe"], cells), "stripe int, cells binary, counts binary, links bigint")
    return written(whole, "count-blocks")


def _ids(model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()


_LINKS = {
    "stripe": "int", "slab": "bigint", "kind": "int", "n_docs": "int", "n_links": "int", "docs": "binary", "rows": "binary", "cols": "binary", "times": "binary",
    "ids": "array<bigint>", "sizes": "array<bigint>", "groups": "array<string>",
}
_SCORES = {"slab": "bigint", "best": "binary", "sums": "binary", "ids": "array<bigint>", "sizes": "array<bigint>", "groups": "array<string>"}
_RESULT = {**dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint"), "groups_sha256": "string"}
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in schema.items())


def _batch(rows: list[tuple], schema: dict[str, str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, _ARROW[t]) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(x.max())).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


def _counted(pair: Pair, times: np.ndarray, stripes: int) -> list[tuple]:
    """Rows of kind 3: of each stripe the id pairs of the table's words, cells in cols, and how many links they have, in times."""
    sizes, _, of_a, of_b = pair.tables()
    weight, n_a = np.repeat(times, sizes[:, 3]), len(pair.a_bytes)
    used = weight > 0
    keys, where = np.unique(of_b[used] * n_a + of_a[used], return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, where, weight[used])
    of_b, of_a = np.divmod(keys, n_a)
    order = np.argsort(of_b % stripes, kind="stable")
    cells, total = ((of_b // stripes) * n_a + of_a)[order].astype(np.uint32), total[order]
    found, edges = np.unique((of_b % stripes)[order], return_index=True)
    edges = [*edges.tolist(), len(cells)]
    return [(s, None, 3, 0, y - x, None, None, cells[x:y].tobytes(), total[x:y].tobytes(), None, None, None) for s, x, y in zip(found.tolist(), edges[:-1], edges[1:], strict=True)]


def _linked(pair: Pair, slab: int, ids: list, words: list[list[int]], stripes: int) -> list[tuple]:
    """A row of kind 0 for a slab's documents, in stripe -1, and one of kind 2 for its links of each stripe: how many each document has, their rows and columns, and how often each."""
    sizes, begins, of_a, of_b = pair.tables()
    flat = np.fromiter(chain.from_iterable(words), np.int64)
    lengths = np.array([len(w) for w in words])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    of_docs = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes[flat], axis=0)])[ends]
    groups = [hashlib.sha256(b";".join([pair.groups[k] for k in w])).hexdigest() if w else "" for w in words]
    rows: list[tuple] = [(-1, slab, 0, len(ids), 0, *[None] * 4, ids, np.diff(of_docs, axis=0).ravel().tolist(), groups)]
    # each different word of a document once
    keys, often = np.unique(np.repeat(np.arange(len(words)), lengths) * max(1, len(sizes)) + flat, return_counts=True)
    doc, word = np.divmod(keys, max(1, len(sizes)))
    n = sizes[word, 3]
    at = np.repeat(begins[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
    doc, often, stripe = np.repeat(doc, n), np.repeat(often, n), of_b[at] % stripes
    order = np.argsort(stripe.astype(np.uint16), kind="stable")
    doc, often, at = doc[order], often[order], at[order]
    row, col = of_b[at] // stripes, of_a[at]
    found, edges = np.unique(stripe[order], return_index=True)
    for s, x, y in zip(found.tolist(), edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True):
        docs = np.bincount(doc[x:y], minlength=len(words))
        rows.append((s, slab, 2, len(ids), y - x, *(_packed(z) for z in (docs, row[x:y], col[x:y], often[x:y])), None, None, None))
    return rows


def _encoding(a: str, b: str, stripes: int, links: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents and links of slabs, and the counts of all links of a task (or of what it had when its table of words was full)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, slab = pair_of(a, b), TaskContext.get().partitionId() << 32
        times = np.zeros(0, np.int64)
        for ids, words in _slabs(pair, batches):
            if links:
                yield _batch(_linked(pair, slab, ids, words, stripes), _LINKS)
            slab += 1
            grown = np.zeros(len(pair.groups), np.int64)
            grown[: len(times)] = times
            times = grown + np.bincount(np.fromiter(chain.from_iterable(words), np.int64), minlength=len(grown))
            if pair.full:
                yield _batch(_counted(pair, times, stripes), _LINKS)
                pair.clear()
                times = np.zeros(0, np.int64)
        if len(times):
            yield _batch(_counted(pair, times, stripes), _LINKS)

    return encode


def _scoring(cells: int, columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by stripe, salt and kind: the block (kind 1) of a stripe, its cells in cols and counts in times, then links (kind 2) of slabs. What is of documents passes."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, used, most = np.zeros(cells, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                slab, kind, n_docs, n, *packed, ids, sizes, groups = (batch[c][k].as_py() for c in list(_LINKS)[1:])
                if kind == 1:
                    dense[used] = 0
                    used = np.frombuffer(packed[2], np.uint32).astype(np.int64)
                    dense[used] = np.frombuffer(packed[3], np.int64)
                    most = dense.reshape(-1, columns).max(axis=1)
                elif kind == 2:
                    docs, row, col, often = (_unpacked(x, m) for x, m in zip(packed, (n_docs, n, n, n), strict=True))
                    count, ends = dense[row * columns + col], np.concatenate([[0], np.cumsum(docs)])
                    best, sums = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (often * (count == most[row]), often * count))
                    out.append((slab, best.tobytes(), sums.tobytes(), None, None, None))
                else:
                    out.append((slab, None, None, ids, sizes, groups))
            yield _batch(out, _SCORES)

    return score


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slab: its documents, and their scores by stripe."""
    last, total, own = None, [0, 0], None

    def taken() -> pa.RecordBatch:
        ids, sizes, groups = own
        scores = (x.tolist() if isinstance(x, np.ndarray) else [0] * len(ids) for x in total)
        return _batch(list(zip(ids, *(sizes[k::4] for k in range(4)), *scores, groups, strict=True)), _RESULT)

    for batch in batches:
        for slab, best, sums, *docs in zip(*(batch[c].to_pylist() for c in _SCORES), strict=True):
            if slab != last:
                if last is not None:
                    yield taken()
                last, total, own = slab, [0, 0], None
            if best is None:
                own = docs
            else:
                total = [x + np.frombuffer(y, np.int64) for x, y in zip(total, (best, sums), strict=True)]
    if last is not None:
        yield taken()


def align(docs: DataFrame, a: str | None = None, b: str | None = None, stripes: int = STRIPES, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose id pair has the highest count of its B id), count_sum (over links) and groups_sha256."""
    small_batches(docs.sparkSession, 250)
    a, b = a or default_path(), b or default_pieces()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = len(byte_tokens(a))
    cells = -(-_ids(b) // stripes) * columns
    encoded = written(texts.mapInArrow(_encoding(a, b, stripes), _ddl(_LINKS)), "links")
    blocks = count_blocks(_counts_of(encoded), a, b, stripes)
    salts = [1] * stripes
    for stripe, links in blocks.select("stripe", "links").collect():  # a row for each stripe
        salts[stripe] = -(-links // group) or 1
    salts_of = F.element_at(F.lit(salts), F.col("stripe") + 1)
    salt = F.when(F.col("stripe") < 0, F.xxhash64("slab")).otherwise(F.pmod(F.xxhash64("slab"), salts_of))
    links = encoded.where("kind <> 3").withColumn("salt", salt)
    read = blocks.select("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts_of - 1).cast("bigint"))).alias("salt"), F.lit(1).alias("kind"), F.col("cells").alias("cols"), F.col("counts").alias("times"))
    dealt = links.unionByName(read, allowMissingColumns=True).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "kind").select(*_LINKS)
    scores = dealt.mapInArrow(_scoring(cells, columns), _ddl(_SCORES))
    return scores.repartition("slab").sortWithinPartitions("slab").mapInArrow(_summed, _ddl(_RESULT))


def _counts_of(encoded: DataFrame) -> DataFrame:
    return encoded.where("kind = 3").select("stripe", F.col("cols").alias("cells"), F.col("times").alias("counts"))


def best_partners(docs: DataFrame, a: str | None = None, b: str | None = None, stripes: int = STRIPES) -> DataFrame:
    """b_id, a_id, count: of each B id with links the A ids of the highest count, ties included."""
    a, b = a or default_path(), b or default_pieces()
    columns = len(byte_tokens(a))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, at, counts in zip(*(batch[c].to_pylist() for c in ("stripe", "cells", "counts")), strict=True):
                row, col = np.divmod(np.frombuffer(at, np.uint32).astype(np.int64), columns)
                counts = np.frombuffer(counts, np.int64)
                first = np.flatnonzero(np.diff(row, prepend=-1))  # cells are in order
                top = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff([*first, len(row)]))
                yield pa.record_batch([pa.array(row[top] * stripes + stripe), pa.array(col[top]), pa.array(counts[top])], ["b_id", "a_id", "count"])

    small_batches(docs.sparkSession, 250)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = _counts_of(texts.mapInArrow(_encoding(a, b, stripes, False), _ddl(_LINKS)))
    return count_blocks(counts, a, b, stripes).select("stripe", "cells", "counts").mapInArrow(best, "b_id bigint, a_id bigint, count bigint")


def token_groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id and its groups as text: ids of A, ids of B, `a1,a2|b1;a3|b2,b3`; empty without tokens."""
    a, b = a or default_path(), b or default_pieces()

    def written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        for ids, words in _slabs(pair, batches):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([b";".join([pair.groups[k] for k in w]).decode() for w in words], pa.large_string()).cast(pa.string())], ["doc_id", "groups"])
            if pair.full:
                pair.clear()

    small_batches(docs.sparkSession, 250)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(written_out, "doc_id bigint, groups string")

"""Token counts by a separator scan over flat, unindexed token files.

A flat file is a run of little-endian uint16 ids in which each document is closed by an end-of-document id; there is no index. It is read
in blocks of equal size. Each block is searched at once for the separator; what it reports - its ids, its separators and their places, the ids
behind the last one - is all that stitching needs. A prefix scan over the blocks of a file carries over the open document and numbers the
documents. The scan has two levels (SUPER blocks each), so a file of any length never meets in one task. The ids are read once: what the blocks
report is written, and the scan's steps read that.

Cases: an empty file or table has no documents; two separators in a row are an empty document; ids behind the last separator are one
document that isn't closed. The separator's own string in a text is ordinary text, so only ends of documents are separators. A null or empty text is an empty document. Repeated rows are documents of their own. A very long
text or document is encoded as one value and stitched over as many blocks as it fills. Of ties any order gives the same rows; extra columns are ignored. Ids over 65,535 don't fit and fail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import slices
from .bpe import default_path, encoder
from .shared import shared_path, small_batches, written

SEPARATOR = 50256
#: Ids in a block.
BLOCK = 1 << 16
#: Blocks in a super block.
SUPER = 1024


def _flattening(path: str, separator: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, number, enc, close, rest = TaskContext.get().partitionId(), 0, encoder(path, special=False), np.array([separator], "<u2").tobytes(), b""

        def out(data: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            number += len(data)
            return pa.record_batch([pa.array([file] * len(data), pa.int64()), pa.array(range(number - len(data), number), pa.int64()), pa.array(data, pa.binary())], ["file", "block", "data"])

        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.frombuffer(enc.encode(t or ""), "<u4") for t in part["text"].to_pylist()]
                if any(len(x) and x.max() > 0xFFFF for x in ids):
                    raise ValueError("a token id does not fit in 16 bits")
                rest += b"".join(x.astype("<u2").tobytes() + close for x in ids)
                whole = len(rest) // (2 * block)
                yield out([rest[2 * block * k : 2 * block * (k + 1)] for k in range(whole)])
                rest = rest[2 * block * whole :]
        yield out([rest] if rest else [])

    return flatten


def write_flat(docs: DataFrame, path: str, tokenizer: str | None = None, separator: int = SEPARATOR, block: int = BLOCK) -> None:
    """Each partition's documents, in order, as one flat file, stored as rows (file, block, data) that only cut it at equal lengths."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    texts.mapInArrow(_flattening(tokenizer or default_path(), separator, block), "file bigint, block bigint, data binary").write.parquet(path)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _reading(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, number, first, count in zip(*(batch[c].to_pylist() for c in ("path", "file", "first", "count")), strict=True):
                store, name = fs.FileSystem.from_uri(quote(path, safe=":/%") if "://" in path or path.startswith("file:") else f"file://{quote(path)}")
                with store.open_input_file(name) as f:
                    for k in range(first, first + count):
                        data = f.read_at(2 * block, 2 * block * k)
                        yield pa.record_batch([pa.array([number]), pa.array([k]), pa.array([data], pa.binary())], ["file", "block", "data"])

    return read


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK, run: int = 256) -> DataFrame:
    """Blocks of plain binary files of any size; `file` is a hash of the name. Spark lists names and lengths only; tasks then read byte ranges of
    `run` blocks (through Arrow's file systems: local, HDFS and object stores)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("file"), F.ceil(F.col("length") / (2 * block)).alias("n"))
    runs = files.where("n > 0").select("path", "file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))).alias("first"))
    runs = runs.select("path", "file", "first", F.least(F.lit(run).cast("long"), F.col("n") - F.col("first")).alias("count"))
    return runs.repartition("path", "first").mapInArrow(_reading(block), "file bigint, block bigint, data binary")


def _searching(separator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u2") for x in batch["data"].to_pylist()]
            at = [np.flatnonzero(x == separator) for x in ids]
            yield pa.record_batch(
                {
                    "file": batch["file"],
                    "block": batch["block"],
                    "n": pa.array([len(x) for x in ids], pa.int64()),
                    "k": pa.array([len(x) for x in at], pa.int64()),
                    "tail": pa.array([len(x) - (int(p[-1]) + 1 if len(p) else 0) for x, p in zip(ids, at, strict=True)], pa.int64()),
                    "at": pa.array(at, pa.list_(pa.int64())),
                }
            )

    return search


def _scan(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add `ids`, `docs` and `open`: ids and separators before a row, and ids since the last of those separators.

    A row is a stretch with n ids, k separators and `tail` ids behind the last of them. The open ids before a row are the tails since
    the latest row with a separator, that row's own included.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = rows.withColumns({"ids": total("n", before), "docs": total("k", before), "_t": total("tail", before)})
    # tails before the latest row with a separator: they grow with the order, so the largest is the latest
    return rows.withColumn("open", F.col("_t") - F.coalesce(F.max(F.when(F.col("k") > 0, F.col("_t"))).over(before), F.lit(0))).drop("_t")


def documents_of(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Rows: file, doc (its number in the file), start (ids before it), n_tokens (without the separator), closed."""
    found = written(blocks.select("file", "block", "data").mapInArrow(_searching(separator), "file bigint, block bigint, n bigint, k bigint, tail bigint, at array<bigint>"), "separators")
    inner = _scan(found.withColumn("super", F.floor(F.col("block") / SUPER).cast("long")), ["file", "super"], "block")
    inner = inner.withColumnsRenamed({"ids": "ids_in", "docs": "docs_in", "open": "open_in"})
    # a super block's tail: the tails since its latest block with a separator, that block's own included
    last = F.max(F.struct("block", F.col("n"), F.col("k"), F.col("tail"), "ids_in", "docs_in", "open_in"))
    supers = inner.groupBy("file", "super").agg(last.alias("z")).select(
        "file", "super", (F.col("z.ids_in") + F.col("z.n")).alias("n"), (F.col("z.docs_in") + F.col("z.k")).alias("k"),
        F.when(F.col("z.k") > 0, F.col("z.tail")).otherwise(F.col("z.open_in") + F.col("z.tail")).alias("tail"),
    )
    outer = _scan(supers, ["file"], "super").select("file", "super", "ids", "docs", "open", (F.col("super") == F.max("super").over(Window.partitionBy("file"))).alias("last_super"), F.col("tail").alias("super_tail"), (F.col("ids") + F.col("n")).alias("end"), (F.col("docs") + F.col("k")).alias("end_docs"), F.col("k").alias("super_k"))
    rows = inner.join(outer, ["file", "super"])
    rows = rows.withColumns({"first": F.col("ids_in") + F.col("ids"), "number": F.col("docs_in") + F.col("docs"), "carry": F.col("open_in") + F.when(F.col("docs_in") == 0, F.col("open")).otherwise(0)})
    closed = rows.where("k > 0").select("file", "number", "first", "carry", "at", F.posexplode("at").alias("i", "p"))
    start = F.when(F.col("i") == 0, F.col("first") - F.col("carry")).otherwise(F.col("first") + F.expr("get(at, i - 1)") + 1)
    closed = closed.select("file", (F.col("number") + F.col("i")).alias("doc"), start.alias("start"), (F.col("first") + F.col("p") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    left = F.col("super_tail") + F.when(F.col("super_k") == 0, F.col("open")).otherwise(0)
    rest = outer.where("last_super").select("file", F.col("end_docs").alias("doc"), (F.col("end") - left).alias("start"), left.alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(rest)


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as flat files in the shared folder and count their tokens from these."""
    path = shared_path(docs.sparkSession, "flat")
    write_flat(docs, path, tokenizer)
    return documents_of(read_flat(docs.sparkSession, path))

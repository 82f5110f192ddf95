"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), and all but the last return the columns of documents.

Every stage decides row by row, by the operator's own verdict; only near duplicates are decided by group, and of each group one row stays: the one with the smallest
doc_id (of several such rows, as repeated rows or rows with the same id are, the one with the smallest digest). Rows without words are in no group; of those repeated exactly
one stays, as with any repeated row. A null doc_id comes after all others; rows whose ids are null are told apart by their texts.

Cases: empty tables pass through every stage. A null text, an empty one or one without letters has no language and is rejected by the first stage. Very long texts are read whole.
Other columns than doc_id, text and lang reach no operator, so whatever their names are they come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontam, lang_ecoc, near_dedup, packing, quality_rules
from loomspark.llm.shared import removed, unused, written


def _filtered(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of docs that `keep` holds for in stage's result. All columns but doc_id, text and lang pass under names that no operator uses."""
    names = {c: c if c in ("doc_id", "text", "lang") else f"carried {k}" for k, c in enumerate(docs.columns)}
    found = stage(docs.select(*[docs[f"`{c}`"].alias(n) for c, n in names.items()])).where(keep)
    return found.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose two best languages are nearly as likely."""
    model = lang_ecoc.fit_sample(docs)
    return _filtered(docs, lambda d: lang_ecoc.predict(d, model), f"lang_pred <> '{lang_ecoc.UNDETERMINED}' AND NOT ambiguous")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rule or a learned rule; the list is learned from the labelled documents that are still there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _filtered(docs, lambda d: quality_rules.quality_rules(d, labels), "kept")


def _digest() -> Column:
    """Of a row's id and text, nulls told apart from empty texts."""
    part = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.when(F.col("text").isNull(), F.lit(" null")).otherwise(F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.unhex(F.md5(part.cast("binary")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, the one with the smallest (doc_id, digest of id and text)."""
    marked = docs.select("doc_id", "text", _digest().alias("row"))
    found = near_dedup.near_duplicates(marked, carry=("row",))
    group = F.coalesce("group_key", "row")  # rows without words are groups of their own
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first(group).alias("group"), F.count("*").alias("n"))
    rows = written(rows, "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "n"))
    stays = written(rows.groupBy("group").agg(first.alias("x")).select("x.row", "x.n"), "stays")
    gone = written(rows.select("row").join(stays, "row", "left_anti"), "gone")
    few = lambda d: F.broadcast(d) if d.count() <= near_dedup.BROADCAST_IDS else d  # 16 bytes each
    own = unused(docs, "row digest")
    mine = docs.withColumn(own, _digest())
    out = mine.join(few(gone), mine[own] == gone["row"], "left_anti")
    repeated = stays.where("n > 1").select("row")
    if repeated.isEmpty():
        return out.select(docs.columns)
    once = out.join(few(repeated), out[own] == repeated["row"], "left_anti")
    again = out.join(few(repeated), out[own] == repeated["row"], "left_semi").dropDuplicates([own])
    return once.unionByName(again).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a window of a benchmark item stands; an item of fewer words than a window is one whole window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _filtered(docs, lambda d: decontam.decontamination(d, benchmark), "NOT contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]
#: Learned rules, hashed components and tokenizers are beyond SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            if before is not None:  # nothing reads it again
                removed(before)
            before = docs
    return docs

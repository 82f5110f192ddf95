"""Exact duplicates by deterministic block naming.

A text, its runs of white space made one space, is cut into blocks of BLOCK bytes. The different blocks of all texts are sorted and named by integers. Then, round by
round, the names of neighbouring blocks of a text form a pair, the different pairs are sorted and named, and each text has half as many names, until one is left: with the
number of its rounds that is the text's identity. By induction equal identities have equal blocks in the same order, so no two texts share one; no hash decides.

1. Blocks are reduced to different ones in each task before they move, so copies cost nothing; what moves once is each different block. Sorting goes by a 64-bit hash and by
   the bytes themselves where hashes are equal, so long common beginnings are not compared.
2. A text's blocks get their names by a join on that hash alone: as all different blocks were named, a hash that belongs to one block only names it. Hashes with several
   blocks (none, as a rule) are found by a count; their blocks are joined by their bytes.
3. Pairs, names and identities are rows of a few integers. A name that a third of all rows have is a skewed side of a join, which adaptive execution splits; groups are
   reduced by aggregates with partial sums.

Rounds: the logarithm of the longest text's number of blocks. All of it is built-in functions.

Cases: a null text is empty; an empty text has one empty block, so all of them are equal. Texts of white space alone are one space and differ from empty ones. Very long texts only add
rounds. Of equal texts the row with the smallest doc_id stays, a null doc_id comes last; of rows with equal doc_id and text exactly one stays. Columns named in `carry` pass, whatever
their names; others are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import removed, written

#: Bytes of a block.
BLOCK = 4096
#: Names of blocks whose hashes clash begin here, above all row numbers.
_CLASHING = 1 << 62


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def _blocks(docs: DataFrame, size: int, hashed) -> DataFrame:
    """A row for each block: uid (of the row), n (blocks of the text), pos, h, block; and doc_id, sha and what is carried, at pos 0 only."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "carried", normalised(F.col("text")).cast("binary").alias("raw"))
    texts = texts.select("uid", "doc_id", "carried", "raw", F.unhex(F.sha2("raw", 256)).alias("sha"), F.greatest(F.lit(1), F.ceil(F.length("raw") / size)).cast("int").alias("n"))
    # outer, so that no filter on the number of blocks is inferred, which would normalise every text twice
    cut = texts.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    first = {c: F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "carried", "sha")}
    cut = cut.select("uid", "n", "pos", *first.values(), F.substring("raw", F.col("pos") * size + 1, F.lit(size)).alias("block"))
    return cut.withColumn("h", hashed(F.col("block")))


def named(rows: DataFrame, *key: str) -> DataFrame:
    """The different rows of `key` with a name each: their number in the order of partition and key."""
    return rows.select(*key).distinct().sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, size: int, hashed) -> tuple[DataFrame, DataFrame]:
    """Rows of blocks without their bytes (a table), and uid, doc_id, n, pos, name (a table)."""
    narrow = ("uid", "doc_id", "carried", "sha", "n", "pos", "h")
    blocks = _blocks(docs, size, hashed)
    names = written(named(blocks, "h", "block").select("h", "name"), "block-names")
    clashes = written(names.groupBy("h").count().where("count > 1").select("h"), "block-clashes")
    tables = [names, clashes]
    if clashes.isEmpty():
        placed = written(blocks.select(*narrow), "blocks")
        found = placed.join(names, "h")
    else:
        marked = blocks.join(clashes.withColumn("clash", F.lit(True)), "h", "left").withColumn("block", F.when(F.col("clash"), F.col("block")))
        placed = written(marked.select(*narrow, "block"), "blocks")
        apart = placed.where("block IS NOT NULL")
        own = named(apart, "h", "block").withColumn("name", F.col("name") + F.lit(_CLASHING))
        found = placed.where("block IS NULL").join(names, "h").unionByName(apart.join(own, ["h", "block"]))
    out = written(found.select("uid", "doc_id", "n", "pos", "name"), "named-0")
    removed(*tables)
    return placed, out


def identities(first: DataFrame) -> DataFrame:
    """uid, doc_id, level and name (the identity) of each text, from the names of its blocks (uid, doc_id, n, pos, name), a table that is removed here; the result is one, too."""
    level, now, done, tables = 0, first, [], [first]
    while True:
        done.append(now.where("n = 1").select("uid", "doc_id", F.lit(level).alias("level"), "name"))
        left = now.where("n > 1")
        if left.isEmpty():
            break
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = left.groupBy("uid", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max("doc_id").alias("doc_id"),
            F.expr("CAST((max(n) + 1) div 2 AS INT)").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),  # an odd one out pairs with nothing
        )
        pairs = written(pairs, f"pairs-{level}")
        now = written(pairs.join(named(pairs, "a", "b"), ["a", "b"]).select("uid", "doc_id", "n", "pos", "name"), f"named-{level}")
        removed(pairs)
        tables.append(now)
    out = written(reduce(DataFrame.unionByName, done), "identities")
    removed(*tables)
    return out


def exact_duplicates(docs: DataFrame, carry: tuple[str, ...] = (), size: int = BLOCK, hashed=block_hash) -> DataFrame:
    """Per row: the columns of `carry`, doc_id, keep_id, group_size, kept, text_sha256 and the identity (identity_level, identity), which holds for this result alone."""
    own = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)))  # names of users need not suit a file
    placed, first = _first_names(docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("carried"), "text"), size, hashed)
    ids = identities(first)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    groups = ids.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))
    out = ids.join(groups, ["level", "name"]).join(placed.where("pos = 0").select("uid", "carried", "sha"), "uid")
    result = {"doc_id": F.col("doc_id"), "keep_id": F.col("keep_id"), "group_size": F.col("group_size"), "kept": F.col("uid") == F.col("keep_uid"), "text_sha256": F.lower(F.hex("sha")), "identity_level": F.col("level"), "identity": F.col("name")}
    return out.select(*(F.col("carried").getField(f"c{k}").alias(c) for k, c in enumerate(carry) if c.lower() not in result), *(v.alias(k) for k, v in result.items()))

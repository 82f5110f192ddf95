"""Pointers from slots of a skeleton to instructions: where a slot's block stands, and for conditions the compare and the branch that decide it and what defined the compared value.

Running sums of block lengths turn blocks into ranges of instruction places; the last compare and the last conditional branch of a range are aggregates, and the definition of a value is the last one
before the compare in the order of places (an as-of join, made as a running maximum over places of one value). Functions are rows of one table; no function is held as a value.

Cases: a slot whose block is not listed or has no instructions has no range; repeated slots have repeated rows. A condition without a compare in its block takes the last one of the function before it.
Values without a definition before come from outside (null). Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Mnemonics that compare, that define their first operand, and conditional branches with the relation that takes them.
COMPARES = ["cmp", "test"]
DEFINES = ["mov", "movzx", "movsx", "lea", "add", "sub", "xor", "and", "or", "inc", "dec", "imul", "shl", "shr", "pop"]
TAKEN = {"je": "eq", "jz": "eq", "jne": "ne", "jnz": "ne", "jl": "lt", "jge": "ge", "jle": "le", "jg": "gt", "jb": "below", "jae": "above_equal", "jbe": "below_equal", "ja": "above", "js": "negative", "jns": "not_negative"}


def placed(blocks: DataFrame) -> DataFrame:
    """blocks (sample, block, n_instructions) with start and stop, the places [start, stop) of their instructions."""
    order = Window.partitionBy("sample").orderBy("block")
    n = F.greatest(F.coalesce("n_instructions", F.lit(0)), F.lit(0))
    stop = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.select("sample", "block", (stop - n).cast("bigint").alias("start"), stop.cast("bigint").alias("stop"))


def _last(what: Column) -> Column:
    return F.max(F.when(what, F.struct("place", "op", "value")))


def pointers(blocks: DataFrame, instructions: DataFrame, edges: DataFrame, slots: DataFrame) -> DataFrame:
    """A row for each slot (sample, slot, kind, block): start, stop, compare_at, branch_at, branch, compared (the value), defined_at, taken_when, n_out and status.

    instructions: (sample, block, ordinal, op, value), value the first operand. Of a `COND` slot the status is `grounded`, or the first thing missing: no_block, no_compare, no_branch, one_way (fewer than two
    edges leave); of others `ok` or no_block. `polarity` says that the relation that takes the branch is known and there are two ways.
    """
    ranges = placed(blocks)
    places = instructions.join(ranges, ["sample", "block"]).select("sample", "block", (F.col("start") + F.col("ordinal")).alias("place"), F.lower("op").alias("op"), "value")
    compares, branches = F.col("op").isin(COMPARES), F.col("op").isin(list(TAKEN))
    within = places.groupBy("sample", "block").agg(_last(compares).alias("own"), _last(branches).alias("branch"))
    # flags live on from the last compare of earlier blocks
    before = Window.partitionBy("sample").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    per_block = ranges.join(within, ["sample", "block"], "left").withColumn("compare", F.last("own", True).over(before))
    # the definition that a compare sees: the last place before it that defines its value
    defines = F.when(F.col("op").isin(DEFINES), F.col("place"))
    seen = places.where("value IS NOT NULL").withColumn("defined_at", F.max(defines).over(Window.partitionBy("sample", "value").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.where(compares).select("sample", F.col("place").alias("compare_at"), "defined_at")
    out = edges.select("sample", F.col("src").alias("block"), "dst").distinct().groupBy("sample", "block").agg(F.count("*").alias("n_out"))
    rows = slots.join(per_block, ["sample", "block"], "left").join(out, ["sample", "block"], "left")
    condition = F.col("kind") == "COND"
    rows = rows.select(
        "sample", "slot", "kind", "block", "start", "stop", F.when(condition, F.col("compare.place")).alias("compare_at"), F.when(condition, F.col("branch.place")).alias("branch_at"), F.when(condition, F.col("branch.op")).alias("branch"),
        F.when(condition, F.col("compare.value")).alias("compared"), F.coalesce("n_out", F.lit(0)).alias("n_out"),
    )
    rows = rows.join(seen, ["sample", "compare_at"], "left")
    names = F.create_map(*[F.lit(x) for pair in TAKEN.items() for x in pair])
    hollow = F.coalesce(F.col("start") >= F.col("stop"), F.lit(True))
    lacks = F.when(F.col("compare_at").isNull(), "no_compare").when(F.col("branch_at").isNull(), "no_branch").when(F.col("n_out") < 2, "one_way")
    status = F.when(hollow, "no_block").when(condition, F.coalesce(lacks, F.lit("grounded"))).otherwise("ok")
    taken = F.when(condition, names[F.col("branch")])
    return rows.select("sample", "slot", "kind", "block", "start", "stop", "compare_at", "branch_at", "branch", "compared", "defined_at", taken.alias("taken_when"), "n_out", (taken.isNotNull() & (F.col("n_out") >= 2)).alias("polarity"), status.alias("status"))


def grounding_rates(rows: DataFrame) -> DataFrame:
    """Per function, from pointers: n, n_ok (grounded or ok), cond_n, and of the conditions the shares that are grounded, have two ways, a known polarity and a known definition (0 without conditions)."""
    condition = F.col("kind") == "COND"
    n = F.greatest(F.count_if(condition), F.lit(1))
    share = lambda c: F.round(F.count_if(condition & c) / n, 6)
    return rows.groupBy("sample").agg(
        F.count("*").alias("n"), F.count_if(F.col("status").isin("grounded", "ok")).alias("n_ok"), F.count_if(condition).alias("cond_n"), share(F.col("status") == "grounded").alias("grounded_rate"), share(F.col("n_out") >= 2).alias("checkable_rate"),
        share(F.col("polarity")).alias("polarity_rate"), share(F.col("defined_at").isNotNull()).alias("defined_rate"),
    )

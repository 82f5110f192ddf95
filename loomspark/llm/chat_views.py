"""Multi-party perspective rotation of dialogues.

For every speaker of a conversation its turns are rendered with that speaker as the assistant and all others as named users; `mask` lists the
character spans that are trained on: what the assistant says, with its closing mark. The role `system` is no speaker: it is context in
every view and never trained on.

A view is the whole dialogue in order. Only a dialogue of over `view_chars` characters is cut, at turns, into contiguous `piece`s of about that size that all its speakers
share; pieces in order are the dialogue, and each has the mask of its own text. So that no conversation meets in one task, turns are first dealt to
ranges of the order (conversation, turn, role, text), and a turn's place in its dialogue comes from a prefix scan: sums of ranges, then sums within a range.

Cases: a null text is an empty turn; a null or empty role is the speaker `unknown`; null conv_ids are one conversation; null turns come last.
Rows repeated exactly are one turn. Of equal turn numbers (or of null ones) the order is by role, then text. Marks in texts are broken
by a space, so a text can't end its turn. A very long text is one turn in a piece of its own size. A conversation of system turns alone has no view. An empty table has no
views. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Characters after which a dialogue is cut.
VIEW_CHARS = 1 << 20
CLOSE, ASSISTANT, SYSTEM, USER = "<|end|>\n", "<|assistant|>\n", "<|system|>\n", ("<|user name=", "|>\n")


def placed_turns(conversations: DataFrame, view_chars: int = VIEW_CHARS) -> DataFrame:
    """The different turns: conv_id, turn, name, content, opening (as others see it), begun (characters before it in a view that has no own turns) and piece."""
    role = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit("unknown")).otherwise(F.trim("role"))
    turns = conversations.select("conv_id", "turn", role.alias("name"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"))
    order = [F.col("turn").asc_nulls_last(), F.col("name"), F.col("content")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows share a range, so duplicates go without another exchange; the table fixes which range a row is in
    turns = turns.repartitionByRange(n, "conv_id", *order).dropDuplicates().withColumn("range", F.spark_partition_id())
    opening = F.when(F.col("name") == "system", F.lit(SYSTEM)).otherwise(F.concat(F.lit(USER[0]), "name", F.lit(USER[1])))
    turns = turns.withColumn("opening", opening).withColumn("size", (F.length("opening") + F.length("content") + len(CLOSE)).cast("long"))
    turns = written(turns, "turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("conv_id", "range").agg(F.sum("size").alias("size"))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ranges_before"))
    turns = turns.join(sums, turns["conv_id"].eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r"))).drop("_c", "_r")
    within = Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("begun", F.col("ranges_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return turns.withColumn("piece", F.floor(F.col("begun") / view_chars).cast("long")).drop("ranges_before", "range", "size")


def perspectives(conversations: DataFrame, view_chars: int = VIEW_CHARS) -> DataFrame:
    """Rows: conv_id, speaker, piece, text, mask ('start-end' pairs, comma-joined, ends outside), n_turns, n_trained."""
    turns = placed_turns(conversations, view_chars)
    speakers = turns.where("name <> 'system'").select(F.col("conv_id").alias("_c"), F.col("name").alias("speaker")).distinct()
    seen = turns.join(speakers, turns["conv_id"].eqNullSafe(F.col("_c")))
    turn = F.struct("begun", "content", "opening", (F.col("name") == F.col("speaker")).alias("mine"))  # no two turns begin at the same place
    view = seen.groupBy("conv_id", "speaker", "piece").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # an own turn's opening differs in length from the one that others see by the same number at every turn
    shorter = f"(length(speaker) + {len(USER[0]) + len(USER[1]) - len(ASSISTANT)})"
    spans = f"""transform(filter(t, x -> x.mine), (x, i) -> concat(x.begun - t[0].begun - i * {shorter} + {len(ASSISTANT)}, '-',
        x.begun - t[0].begun - i * {shorter} + {len(ASSISTANT)} + length(x.content) + {len(CLOSE)}))"""
    return view.select(
        "conv_id",
        "speaker",
        "piece",
        F.array_join(F.transform("t", lambda x: F.concat(F.when(x["mine"], F.lit(ASSISTANT)).otherwise(x["opening"]), x["content"], F.lit(CLOSE))), "").alias("text"),
        F.expr(f"array_join({spans}, ',')").alias("mask"),
        F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda x: x["mine"])).cast("long").alias("n_trained"),
    )


def perspectives_sql(view_chars: int = VIEW_CHARS) -> str:
    """The same rows in DuckDB's SQL."""
    return f"""
        WITH t AS (SELECT DISTINCT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS name,
                          replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
             p AS (SELECT *, CASE WHEN name = 'system' THEN '<|system|>' ELSE '<|user name=' || name || '|>' END || chr(10) AS opening FROM t),
             c AS (SELECT *, CAST(floor(coalesce(sum(length(opening) + length(content) + 8) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, name, content
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {view_chars}.0) AS BIGINT) AS piece FROM p),
             s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
             v AS (SELECT c.conv_id, speaker, piece, turn, name, content, name = speaker AS mine, CASE WHEN name = speaker THEN '<|assistant|>' || chr(10) ELSE opening END AS opening
                   FROM c JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
             o AS (SELECT *, length(opening) + length(content) + 8 AS size,
                          coalesce(sum(length(opening) + length(content) + 8) OVER (PARTITION BY conv_id, speaker, piece ORDER BY turn NULLS LAST, name, content
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM v)
        SELECT conv_id, speaker, piece,
               string_agg(opening || content || '<|end|>' || chr(10), '' ORDER BY turn NULLS LAST, name, content) AS text,
               coalesce(string_agg(CAST(begun + length(opening) AS BIGINT) || '-' || CAST(begun + size AS BIGINT), ',' ORDER BY turn NULLS LAST, name, content) FILTER (mine), '') AS mask,
               count(*) AS n_turns, count(*) FILTER (mine) AS n_trained
        FROM o GROUP BY conv_id, speaker, piece"""

"""Queries on validation, JSON Lines round trips and ordered state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import validate as V
from loomspark.sources import jsonl as J
from loomspark.streaming import curriculum as C

from .tables import read


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Core records out of orders: a block per line item, every order's last one without a label where it was returned."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.max("l_returnflag").alias("flag"))
    fill = lambda value, times: F.array_repeat(F.lit(value), times)
    row = F.array_repeat(F.lit(0.5), F.col("n"))
    return lines.select(
        "l_orderkey", fill(2, F.col("n")).alias("bin_block_lengths"), fill(7, 2 * F.col("n")).alias("bin_opcodes"), fill(1, 6 * F.col("n")).alias("bin_operand_types"),
        fill(1, F.when(F.col("n") == 5, 29).otherwise(6 * F.col("n"))).alias("bin_operand_values"), fill(0, F.when(F.col("flag") == "R", F.col("n") - 1).otherwise(F.col("n"))).alias("pattern_labels"),
        F.array_repeat(F.array_repeat(F.lit(0.0), 12), F.col("n")).alias("bin_struct_features"), F.array(fill(0, F.col("n")), fill(0, F.col("n"))).alias("bin_edge_index"), fill(1, F.col("n")).alias("bin_edge_type"),
        fill(3, F.col("n")).alias("src_token_ids"), fill(1, F.when(F.col("n") == 1, 0).otherwise(F.col("n"))).alias("src_stmt_lengths"), fill(3, F.col("n")).alias("src_ast_types"),
        F.array(fill(0, F.lit(1)), fill(0, F.lit(1))).alias("src_edge_index"), fill(1, F.lit(1)).alias("src_edge_type"),
        F.array_repeat(row, F.col("n")).alias("alignment_matrix"), F.array_repeat(row, F.when(F.col("n") == 3, 2).otherwise(F.col("n"))).alias("alignment_confidence"),
        F.lit(None).cast("array<int>").alias("sft_input_ids"), F.lit(None).cast("array<int>").alias("sft_labels"), F.lit(None).cast("array<string>").alias("slot_types"),
    )


def shape_errors(spark: SparkSession, d: str) -> DataFrame:
    c = V.checked(_samples(spark, d))
    return c.groupBy(*[F.coalesce(e, F.lit("ok")).alias(e) for e in ("error", "error_source", "error_alignment", "error_sft")]).agg(F.count("*").alias("n"))


def sparse_cells(spark: SparkSession, d: str) -> DataFrame:
    return V.cells(_samples(spark, d), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n_cells"), F.round(F.sum("m"), 6).alias("mass"), F.round(F.sum("w"), 6).alias("weight"))


def block_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.blocks(_samples(spark, d), "l_orderkey").select("l_orderkey", "b", "first", "length", "label")


def expected_grid_missing(spark: SparkSession, d: str) -> DataFrame:
    grid = J.expected_grid(spark, [f"src{k}" for k in range(22)], ["en", "de", "it"], "{project}-{level}")
    found = read(spark, d, "documents").groupBy(F.concat_ws("-", "source", "lang").alias("file")).agg(F.count("*").alias("n_rows"))
    return J.with_missing(grid, found).select("project", "level", "status", "n_rows")


def curriculum_replay(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    return C.replay(e, "user_id", "event_id", "value", C.Rules(2, 6, 3, 0.5, 4)).select("user_id", "event_id", "stage", "event")


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return C.early_stop(read(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 10)


QUERIES = {f.__name__: f for f in (shape_errors, sparse_cells, block_rows, expected_grid_missing, curriculum_replay, early_stop)}
_L = "WITH l AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY 1)"
ORACLES = {
    "shape_errors": f"""{_L}, e AS (SELECT n, CASE WHEN n = 5 THEN 'operand values are not 3 per instruction' WHEN flag = 'R' THEN 'labels do not match blocks' END AS e FROM l),
        s AS (SELECT n, e, coalesce(e, CASE WHEN n = 1 THEN 'source side missing' END) AS s FROM e), a AS (SELECT e, s, coalesce(s, CASE WHEN n = 3 THEN 'alignment_confidence rows do not match blocks' END) AS a FROM s)
        SELECT coalesce(e, 'ok') AS error, coalesce(s, 'ok') AS error_source, coalesce(a, 'ok') AS error_alignment, coalesce(a, 'no supervised ids') AS error_sft, count(*) AS n FROM a GROUP BY ALL""",
    "sparse_cells": f"{_L} SELECT l_orderkey, CAST(n AS BIGINT) * n AS n_cells, round(0.5 * n * n, 6) AS mass, round(CASE WHEN n = 3 THEN 3.0 ELSE 0.5 * n * n END, 6) AS weight FROM l",
    "block_rows": f"{_L}, b AS (SELECT l_orderkey, n, flag, CAST(unnest(range(n)) AS INTEGER) AS b FROM l) SELECT l_orderkey, b, CAST(2 * b AS INTEGER) AS first, CAST(2 AS INTEGER) AS length, CAST(CASE WHEN flag = 'R' AND b = n - 1 THEN NULL ELSE 0 END AS INTEGER) AS label FROM b",
    "expected_grid_missing": """
        WITH g AS (SELECT 'src' || p AS project, level FROM range(22) t(p), (SELECT unnest(['en', 'de', 'it']) AS level)), f AS (SELECT source AS project, lang AS level, count(*) AS n_rows FROM documents GROUP BY 1, 2)
        SELECT project, level, CASE WHEN n_rows IS NULL THEN 'MISSING' ELSE 'ok' END AS status, n_rows FROM g LEFT JOIN f USING (project, level)""",
    "curriculum_replay": """
        WITH RECURSIVE e AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
             t AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 0 AS stage, '' AS event, 0 AS next, 0 AS ep, 0 AS bad, CAST('Infinity' AS DOUBLE) AS best, false AS stop FROM e UNION ALL
                   SELECT user_id, n, event_id, stage, CASE WHEN stop THEN 'over' WHEN why = '' THEN 'stay' WHEN stage >= 4 THEN 'stop:' || why ELSE 'advance:' || why END, CASE WHEN NOT stop AND why <> '' AND stage < 4 THEN stage + 1 ELSE stage END,
                          CASE WHEN why <> '' THEN 0 ELSE ep END, CASE WHEN why <> '' THEN 0 ELSE bad END, CASE WHEN why <> '' THEN CAST('Infinity' AS DOUBLE) ELSE best END, stop OR why <> '' AND stage >= 4
                   FROM (SELECT *, CASE WHEN ep >= 6 THEN 'max_epochs' WHEN ep >= 2 AND bad >= 3 THEN 'patience' ELSE '' END AS why
                         FROM (SELECT e.user_id, e.n, e.event_id, t.next AS stage, t.ep + 1 AS ep, CASE WHEN e.v < t.best - 0.5 THEN 0 ELSE t.bad + 1 END AS bad, CASE WHEN e.v < t.best - 0.5 THEN e.v ELSE t.best END AS best, t.stop FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)))
        SELECT user_id, event_id, CAST(stage AS INTEGER) AS stage, event FROM t WHERE n > 0""",
    "early_stop": """
        WITH b AS (SELECT user_id, event_id, row_number() OVER w AS n, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
             s AS (SELECT *, n - max(CASE WHEN new THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM b)
        SELECT user_id, min(event_id) FILTER (since >= 10) AS stop_at, count(*) AS n_epochs FROM s GROUP BY 1""",
}

"""Queries on block roles and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import labels as L

from .tables import read


def _statements(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), n.alias("id")).agg(F.min("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("c"))
    return rows.select("sample", "id", (F.col("f") == "R").alias("compound"), (F.col("c") == "F").alias("control"), (F.col("q") % 4).alias("depth"), F.col("id").alias("start_line"), (F.col("id") + F.col("q") % 3).alias("end_line"))


def lines_to_statement(spark: SparkSession, d: str) -> DataFrame:
    s = _statements(spark, d)
    lines = s.select("sample", F.floor((F.col("id") + 1) / 2).cast("long").alias("b"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("line"))
    return L.lines_to_statement(lines, s)


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("b")).agg(F.min("l_suppkey").alias("k"), F.max("l_returnflag").alias("f"))
    blocks = rows.select("sample", "b", F.when(F.col("f") == "R", 5).otherwise(0).alias("role"), F.when(F.col("f") != "A", F.floor((F.col("b") + 1) / 2).cast("long")).alias("s"), F.when(F.col("f") != "A", F.when(F.col("b") <= 4, 2).otherwise((F.col("k") % 13).cast("int"))).cast("int").alias("ast"))
    e = rows.select("sample", "b", "k").withColumn("d", F.explode(F.sequence(F.lit(1), F.when(F.col("k") % 2 == 0, 2).otherwise(1))))
    edges = e.select("sample", F.col("b").alias("src"), (F.col("b") + F.col("d")).alias("dst"), F.when(F.col("k") % 2 == 0, 0).otherwise(1).alias("etype"))
    return blocks, edges.join(rows.select("sample", F.col("b").alias("dst")), ["sample", "dst"], "left_semi")


def pattern_refinement(spark: SparkSession, d: str) -> DataFrame:
    blocks, edges = _blocks(spark, d)
    return L.refined(blocks, edges).select("sample", "b", F.col("refined").cast("int").alias("refined"))


def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    blocks, edges = _blocks(spark, d)
    return L.confusion(L.refined(blocks, edges).withColumn("refined", F.col("refined").cast("int")), "role", "refined")


def label_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders")
    price = F.col("o_totalprice").cast("long")
    words = F.array(*map(F.lit, ["if (x)", "case 1:", "return 0;", "break;", "x = 1;", "while (y)"]))
    blocks = rows.select(
        F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("b"), (price % 10).cast("int").alias("role"), F.get(words, (price % 6).cast("int")).alias("text"), (F.col("o_orderstatus") == "F").alias("branches"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("n_out"), (F.col("o_orderpriority") == "1-URGENT").alias("back_source"), (price % 11 == 0).alias("loop_header"), (F.col("o_orderpriority") == "2-HIGH").alias("loop_exit"),
        (price % 13 == 0).alias("switch_header"), (price % 6 == 1).alias("switch_case"),
    )
    return L.repaired(blocks).select("b", F.col("repaired").cast("int").alias("repaired"))


def compatibility_penalty(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")  # noqa: E741
    # a line without a role has its share, which no type goes with
    roles = l.groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("b")).agg(F.collect_set(F.coalesce((F.col("l_partkey") % 10).cast("int"), F.lit(-1))).alias("roles"))
    shares = roles.select("sample", "b", F.explode("roles").alias("role"), (1 / F.size("roles")).alias("p"))
    statements = l.groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("s")).agg((F.min("l_suppkey") % 16).cast("int").alias("ast"))
    return L.type_penalty(shares, statements, spark, ["sample"])


def compact_remap(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return L.remapped(rows, read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def matching_costs(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    c = L.cost_components(F.col("p_size") / 50, F.col("p_size") > 20, F.col("p_size") % 7, F.col("p_size") < 10, F.col("p_retailprice") > 1000)
    return p.select("p_partkey", c.alias("c")).select("p_partkey", F.round("c.semantic_distance", 6).alias("distance"), "c.rewrite_cost", F.round("c.block_bonus", 6).alias("block_bonus"), "c.polarity", F.size("c.unavailable").alias("n_unavailable"))


QUERIES = {f.__name__: f for f in (lines_to_statement, pattern_refinement, label_confusion, label_repair, compatibility_penalty, compact_remap, matching_costs)}

# pairs of a role and a statement type that it may stand for, by the numbers of both, written out by hand
_BRIDGE = """(0, 0), (0, 1), (0, 13), (0, 14), (0, 15), (1, 2), (2, 0), (2, 1), (2, 12), (2, 13), (2, 14), (2, 15), (3, 0), (3, 1), (3, 12), (3, 13), (3, 14), (3, 15), (4, 3), (4, 4), (4, 5),
    (5, 0), (5, 1), (5, 12), (5, 13), (5, 14), (5, 15), (6, 8), (6, 9), (6, 10), (6, 15), (7, 6), (8, 0), (8, 7), (8, 9), (8, 15), (9, 1), (9, 8), (9, 15)"""
_REFINED = """r AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS b, min(l_suppkey) AS k, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
    bl AS (SELECT sample, b, CASE WHEN f = 'R' THEN 5 ELSE 0 END AS role, CASE WHEN f <> 'A' THEN (b + 1) // 2 END AS s, CASE WHEN f <> 'A' THEN CASE WHEN b <= 4 THEN 2 ELSE k % 13 END END AS t FROM r),
    e AS (SELECT x.sample, x.b AS src, y.b AS dst, k % 2 AS et FROM r x JOIN bl y ON y.sample = x.sample AND (y.b = x.b + 1 OR k % 2 = 0 AND y.b = x.b + 2)),
    o AS (SELECT sample, src AS b, count(*) AS n_out, bool_or(et = 0) AS cond FROM e GROUP BY 1, 2), i AS (SELECT sample, dst AS b, count(*) AS n_in, min(src) AS p FROM e GROUP BY 1, 2),
    x AS (SELECT bl.*, coalesce(n_out, 0) AS n_out, coalesce(cond, false) AS cond, coalesce(n_in, 0) AS n_in, p FROM bl LEFT JOIN o USING (sample, b) LEFT JOIN i USING (sample, b)),
    y AS (SELECT x.*, CASE WHEN x.role = 0 AND x.s IS NOT NULL THEN CASE WHEN x.t = 2 AND x.cond THEN 1 WHEN x.t = 2 AND x.n_in = 1 AND q.cond AND q.s = x.s THEN 2 WHEN x.t IN (3, 4, 5) THEN 4 WHEN x.t = 6 THEN 7 WHEN x.t = 7 THEN 8 WHEN x.t IN (8, 9, 10, 11) AND x.n_out = 0 THEN 9 ELSE 0 END ELSE x.role END AS r1
          FROM x LEFT JOIN x q ON q.sample = x.sample AND q.b = x.p),
    h AS (SELECT e.sample, e.dst AS b, list(y.s) AS hs FROM e JOIN y ON y.sample = e.sample AND y.b = e.src AND y.r1 = 1 AND y.t = 2 GROUP BY 1, 2),
    z AS (SELECT sample, b, role, CAST(CASE WHEN r1 = 0 AND s IS NOT NULL AND hs IS NOT NULL THEN CASE WHEN list_contains(hs, s) THEN 2
                 WHEN n_in = 1 THEN CASE WHEN t IN (8, 9, 10, 11) AND n_out = 1 AND (SELECT max(w.n_out) FROM e JOIN x w ON w.sample = e.sample AND w.b = e.dst WHERE e.sample = y.sample AND e.src = y.b) = 0 THEN 2 ELSE 3 END ELSE 0 END ELSE r1 END AS INTEGER) AS refined FROM y LEFT JOIN h USING (sample, b))"""
ORACLES = {
    "pattern_refinement": f"WITH {_REFINED} SELECT sample, b, refined FROM z",
    "label_confusion": f"WITH {_REFINED} SELECT CAST(role AS INTEGER) AS role, refined, count(*) AS n FROM z GROUP BY 1, 2",
    "lines_to_statement": """
        WITH s AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS id, CAST(min(l_quantity) AS BIGINT) AS q, max(l_returnflag) = 'R' AS compound, max(l_linestatus) = 'F' AS control FROM lineitem GROUP BY 1, 2),
             t AS (SELECT *, q % 4 AS depth, id AS a, id + q % 3 AS z FROM s), l AS (SELECT DISTINCT sample, (id + 1) // 2 AS b, unnest([id, id + 1]) AS line FROM s),
             h AS (SELECT DISTINCT sample, b, id, compound, control, depth, z - a AS span FROM (SELECT l.sample, l.b, l.line, t.* EXCLUDE (sample) FROM l JOIN t ON t.sample = l.sample AND line BETWEEN a AND z
                   QUALIFY row_number() OVER (PARTITION BY l.sample, l.b, line ORDER BY compound, depth DESC, z - a, id) = 1)),
             p AS (SELECT * FROM h WINDOW w AS (PARTITION BY sample, b) QUALIFY count(*) OVER w = 1 OR NOT (compound AND bool_or(NOT compound) OVER w)),
             d AS (SELECT *, max(depth) OVER (PARTITION BY sample, b) AS md FROM p)
        SELECT sample, b, CASE WHEN count(*) = 1 THEN min(id) WHEN count(*) FILTER (control) = 1 THEN max(id) FILTER (control) ELSE arg_min(id, (-depth, span, id)) END AS id,
               CASE WHEN count(*) = 1 THEN 0.95 WHEN count(*) FILTER (control) = 1 THEN 0.85 WHEN count(*) FILTER (depth = md) = 1 THEN 0.8 ELSE 0.6 END AS confidence FROM d GROUP BY 1, 2""",
    "label_repair": r"""
        WITH o AS (SELECT o_orderkey AS b, CAST(round(trunc(o_totalprice)) AS BIGINT) AS x, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
             t AS (SELECT *, x % 10 AS role, ['if (x)', 'case 1:', 'return 0;', 'break;', 'x = 1;', 'while (y)'][x % 6 + 1] AS text, st = 'F' AS br, CASE WHEN st = 'P' THEN 0 ELSE 1 END AS n_out, pr = '1-URGENT' AS bs, x % 11 = 0 AS lh, pr = '2-HIGH' AS le, x % 13 = 0 AS sh FROM o),
             f AS (SELECT *, text = 'if (x)' AND br AS fi, text = 'case 1:' AS ca, text IN ('return 0;', 'break;') AS te, text = 'break;' AS lv FROM t),
             a AS (SELECT *, CASE WHEN ca AND NOT sh THEN 8 WHEN sh THEN 7 WHEN lh THEN 4 WHEN role = 4 THEN CASE WHEN fi THEN 1 WHEN ca THEN 8 WHEN te AND (le OR n_out = 0) THEN 6 ELSE 0 END WHEN role = 7 THEN CASE WHEN ca THEN 8 WHEN fi THEN 1 ELSE 0 END ELSE role END AS r FROM f),
             b1 AS (SELECT * REPLACE (CASE WHEN r IN (0, 2, 3) AND bs THEN 5 ELSE r END AS r) FROM a), b2 AS (SELECT * REPLACE (CASE WHEN r IN (0, 2, 3) AND le THEN 6 ELSE r END AS r) FROM b1),
             b3 AS (SELECT * REPLACE (CASE WHEN r NOT IN (1, 4, 5, 6, 7, 8) AND lv THEN 6 ELSE r END AS r) FROM b2), b4 AS (SELECT * REPLACE (CASE WHEN r NOT IN (4, 7, 8) AND fi THEN 1 ELSE r END AS r) FROM b3)
        SELECT b, CAST(CASE WHEN r NOT IN (1, 4, 5, 6, 7, 8) AND te AND n_out = 0 THEN 9 ELSE r END AS INTEGER) AS repaired FROM b4""",
    "compatibility_penalty": f"""
        WITH c(role, ast) AS (VALUES {_BRIDGE}), r AS (SELECT DISTINCT l_orderkey AS sample, l_linenumber AS b, l_partkey % 10 AS role FROM lineitem), p AS (SELECT *, 1 / count(*) OVER (PARTITION BY sample, b) AS p FROM r),
             s AS (SELECT l_orderkey AS sample, l_linenumber AS s, min(l_suppkey) % 16 AS ast FROM lineitem GROUP BY 1, 2)
        SELECT p.sample, p.b, s.s, round(1 - coalesce(sum(p.p) FILTER (c.role IS NOT NULL), 0), 6) AS penalty FROM p JOIN s ON s.sample = p.sample LEFT JOIN c ON c.role = p.role AND c.ast = s.ast GROUP BY 1, 2, 3""",
    "compact_remap": "SELECT row_number() OVER (ORDER BY c_custkey) AS new_id, c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "matching_costs": """
        SELECT p_partkey, CASE WHEN ok THEN round(greatest(0, least(1, 1 - p_size / 50)), 6) END AS distance, CASE WHEN ok THEN CASE WHEN p_size > 20 THEN 0.12 ELSE 0.0 END END AS rewrite_cost, CASE WHEN ok THEN round(least(0.1, 0.02 * (p_size % 7)), 6) END AS block_bonus,
               CASE WHEN ok AND p_size >= 10 THEN 0.0 END AS polarity, CAST(CASE WHEN ok THEN 8 ELSE 1 END AS INTEGER) AS n_unavailable FROM (SELECT *, p_retailprice > 1000 AS ok FROM part)""",
}

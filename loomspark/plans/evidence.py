"""Queries on built graphs, evidence checks and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import evidence as V
from loomspark.operators import losses as M

from .joining import _CELLS, _cells
from .tables import by_order, read


def _instructions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as instructions: one address apart, jumps two to five places on or back."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "value").withColumn("n", F.row_number().over(w).cast("long"))
    kind = F.when(F.col("event_type") == "purchase", "jump").when(F.col("event_type") == "signup", "branch").when(F.col("event_type") == "error", "ret").when((F.col("event_type") == "click") & (F.col("value") > 60), "call").otherwise("other")
    target = F.when(F.col("event_type").isin("purchase", "signup"), (F.col("n") + F.when(F.col("value") > 50, 5).otherwise(-3)) * 4)
    return e.select(F.col("user_id").alias("sample"), (F.col("n") * 4).alias("addr"), F.lit(4).cast("long").alias("size"), kind.alias("kind"), target.alias("target"))


def cfg_blocks(spark: SparkSession, d: str) -> DataFrame:
    return V.control_flow(_instructions(spark, d))[0].select("sample", F.col("b").cast("long").alias("b"), "start", "end")


def cfg_edges(spark: SparkSession, d: str) -> DataFrame:
    return V.control_flow(_instructions(spark, d))[1].groupBy("sample", "etype").agg(F.count("*").alias("n"), F.sum("src").cast("long").alias("s"), F.sum("dst").cast("long").alias("d"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return by_order(spark, d).select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("b"), (F.col("l_partkey") % 20).alias("line"), F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 10).alias("c"))


def soft_matrix(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return V.soft_cells(lines, V.line_columns(lines)).select("sample", "b", F.col("s").cast("long").alias("s"), F.round("m", 6).alias("m"), F.round("w", 6).alias("w"))


def overlap_violations(spark: SparkSession, d: str) -> DataFrame:
    statements = by_order(spark, d).groupBy(F.col("l_orderkey").alias("sample"), (F.col("l_suppkey") % 8).alias("s")).agg(F.min(F.col("l_partkey") % 20).alias("start_line"), F.max(F.col("l_partkey") % 20).alias("end_line"))
    return V.overlap_violations(_cells(spark, d), _lines(spark, d).select("sample", "b", "line"), statements, high=0.5)


def column_statements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 20
    statements = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("id")).agg(
        (F.max("l_returnflag") == "R").alias("compound"), (F.min("l_suppkey") % 3).alias("depth"), F.min(k).alias("start_line"), (F.min(k) + F.min("l_suppkey") % 5).alias("end_line"))
    return V.column_statements(_cells(spark, d), _lines(spark, d), statements, least=5.0)


def region_mask(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    b = cells.select("sample", F.lit("b").alias("side"), F.col("b").alias("node"), (F.col("b") % 2).alias("region")).distinct()
    s = cells.select("sample", F.lit("s").alias("side"), F.col("s").alias("node"), F.floor(F.col("s") / 3).cast("long").alias("region")).distinct()
    return V.region_mask(cells, b.union(s), least=30.0).select("sample", "region", "s_region", F.round("mass", 6).alias("mass"))


def best_source_index(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    return V.best_source(docs, ["lang", "source"], F.col("source") > "src5", "doc_id").select("key", "doc_id")


def primary_file(spark: SparkSession, d: str) -> DataFrame:
    return V.primary_file(read(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


def outline_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_quantity").distinct()
    return V.normal_depths(rows, ["l_orderkey"], "l_quantity").select("l_orderkey", "l_quantity", F.col("level").cast("long").alias("level"))


def agreement_rates(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("n_both"), F.count_if(F.col("l_returnflag") == "N").alias("n_agree"), F.count_if(F.col("l_returnflag") == "A").alias("n_near"))
    return V.agreement(per, ["l_linestatus"], "n_both", "n_agree", "n_near")


def signal_means(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_both"), F.nullif(F.count_if(F.col("l_returnflag") == "N"), F.lit(0)).alias("n_agree"), F.count_if(F.col("l_returnflag") == "A").alias("n_near"))
    return V.counter_means(per, ["n_both", "n_agree", "n_near"])


def verdict_packing(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("tier", F.substring("o_orderpriority", 1, 1).cast("int"))
    return V.packed_verdicts(o, "o_custkey", F.col("o_totalprice") > 50000, F.col("tier"), 3, F.col("o_orderstatus") != "P")


def evidence_split(spark: SparkSession, d: str) -> DataFrame:
    return V.evidence_split(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag"), ["R"])


def structure_grades(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_returnflag") != "R").alias("ok"), (F.avg("l_discount") * 4).alias("empty"), (F.avg("l_tax") * 20).alias("order"), F.avg(F.when(F.col("l_discount") > 0, F.col("l_quantity") / 30)).alias("coverage"))
    grade, notes = V.structure_grade(F.col("ok"), F.col("empty"), F.col("order"), F.col("coverage"))
    return per.select("l_orderkey", grade.alias("grade"), F.array_join(notes, ",").alias("notes"))


def pattern_reliability(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumn("p", 0.2 + F.col("l_quantity") / 100)
    return rows.groupBy("l_orderkey").agg(F.round(M.pattern_reliability("p", F.col("l_returnflag") == "R", F.lit(1), F.lit(8)), 6).alias("reliability"))


def _sims(spark: SparkSession, d: str) -> DataFrame:
    # a function has some dozens of rows
    e = read(spark, d, "embeddings").select(F.concat_ws("/", "label", F.floor(F.col("vec_id") / 640).cast("string")).alias("label"), "vec_id", F.col("embedding").alias("v"))
    return M.similarities(e.withColumnRenamed("vec_id", "a"), e.withColumnRenamed("vec_id", "b"), ["label"], "a", "b", 0.5)


def region_infonce(spark: SparkSession, d: str) -> DataFrame:
    return M.multi_positive(_sims(spark, d).withColumn("pos", F.abs(F.col("a") - F.col("b")) <= 10), ["label"], "a")


def neighbour_loss(spark: SparkSession, d: str) -> DataFrame:
    sims = _sims(spark, d).withColumnsRenamed({"a": "src", "b": "dst"})
    edges = sims.where("dst > src AND dst <= src + 20").select("label", "src", "dst")
    return M.neighbour_reconstruction(sims, edges, ["label"])


def plan_error(spark: SparkSession, d: str) -> DataFrame:
    sims = _sims(spark, d)
    target = sims.where("b = a OR b = a + 10").select("label", "a", "b", F.when(F.col("a") == F.col("b"), 3.0).otherwise(1.0).alias("m"))
    return M.plan_error(sims, target, ["label"], "a", "b")


def hard_negative_loss(spark: SparkSession, d: str) -> DataFrame:
    return M.hard_negative_rows(_sims(spark, d).withColumn("pos", (F.col("b") - F.col("a")).between(0, 10)), ["label"], "a", "b", 5)


def test_vectors(spark: SparkSession, d: str) -> DataFrame:
    return V.test_vectors(spark, 2, "seed", 60).select("case_id", F.array_join("vec", ",").alias("vec"))


QUERIES = {
    f.__name__: f
    for f in (
        cfg_blocks, cfg_edges, soft_matrix, overlap_violations, column_statements, region_mask, best_source_index, primary_file, outline_levels, agreement_rates, signal_means, verdict_packing, evidence_split, structure_grades, pattern_reliability,
        region_infonce, neighbour_loss, plan_error, hard_negative_loss, test_vectors,
    )
}

_I = """i AS (SELECT user_id AS sample, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type AS t, value AS v FROM events),
    k AS (SELECT sample, n, CASE t WHEN 'purchase' THEN 'jump' WHEN 'signup' THEN 'branch' WHEN 'error' THEN 'ret' ELSE CASE WHEN t = 'click' AND v > 60 THEN 'call' ELSE 'other' END END AS kind, CASE WHEN t IN ('purchase', 'signup') THEN n + CASE WHEN v > 50 THEN 5 ELSE -3 END END AS tn FROM i),
    l AS (SELECT *, lag(kind IN ('jump', 'branch', 'ret'), 1, true) OVER (PARTITION BY sample ORDER BY n) OR (sample, n) IN (SELECT (sample, tn) FROM k WHERE tn IS NOT NULL) AS lead FROM k),
    x AS (SELECT *, sum(lead::INT) OVER (PARTITION BY sample ORDER BY n) - 1 AS b FROM l), z AS (SELECT * FROM x QUALIFY n = max(n) OVER (PARTITION BY sample, b))"""
_SIM = "em AS (SELECT label || '/' || vec_id // 640 AS label, vec_id, embedding FROM embeddings), s AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / 0.5 AS sim FROM em x JOIN em y USING (label))"
_LINES = "l AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS b, l_partkey % 20 AS line, CASE WHEN l_discount > 0.02 THEN l_discount * 10 END AS c FROM lineitem)"
ORACLES = {
    "cfg_blocks": f'WITH {_I} SELECT sample, CAST(b AS BIGINT) AS b, min(n) * 4 AS start, max(n) * 4 + 4 AS "end" FROM x GROUP BY 1, 2',
    "cfg_edges": f"""WITH {_I}, e AS (SELECT z.sample, z.b AS src, t.b AS dst, CASE WHEN t.b <= z.b THEN 2 WHEN z.kind = 'jump' THEN 1 ELSE 0 END AS etype FROM z JOIN x t ON t.sample = z.sample AND t.n = z.tn UNION ALL
        SELECT z.sample, z.b, z.b + 1, CASE z.kind WHEN 'branch' THEN 0 WHEN 'call' THEN 3 ELSE 1 END FROM z WHERE z.kind NOT IN ('jump', 'ret') AND (z.sample, z.b + 1) IN (SELECT (sample, b) FROM x))
        SELECT sample, etype, count(*) AS n, CAST(sum(src) AS BIGINT) AS s, CAST(sum(dst) AS BIGINT) AS d FROM e GROUP BY 1, 2""",
    "soft_matrix": f"WITH {_LINES}, k AS (SELECT sample, line, dense_rank() OVER (PARTITION BY sample ORDER BY line) - 1 AS s FROM (SELECT DISTINCT sample, line FROM l)), h AS (SELECT l.sample, b, s, max(coalesce(c, 0.85)) AS c FROM l JOIN k USING (sample, line) GROUP BY 1, 2, 3) SELECT sample, b, s, round(1 / count(*) OVER w, 6) AS m, round(c / count(*) OVER w, 6) AS w FROM h WINDOW w AS (PARTITION BY sample, b)",
    "overlap_violations": f"""WITH {_CELLS}, {_LINES}, st AS (SELECT l_orderkey AS sample, l_suppkey % 8 AS s, min(l_partkey % 20) AS a, max(l_partkey % 20) AS z FROM lineitem GROUP BY 1, 2),
        mt AS (SELECT DISTINCT l.sample, l.b, st.s FROM l JOIN st ON st.sample = l.sample AND line BETWEEN a AND z), p AS (SELECT sample, b, s FROM c QUALIFY row_number() OVER (PARTITION BY sample, b ORDER BY m DESC, s) = 1)
        SELECT sample, count(*) AS n_blocks, count(*) FILTER ((sample, b, s) NOT IN (SELECT (sample, b, s) FROM mt)) AS bad_peaks, coalesce(max(k.bad), 0) AS bad_cells
        FROM p LEFT JOIN (SELECT sample, count(*) AS bad FROM c WHERE m > 0.01 AND w >= 0.5 AND (sample, b, s) NOT IN (SELECT (sample, b, s) FROM mt) GROUP BY 1) k USING (sample) GROUP BY 1""",
    "column_statements": f"""WITH {_CELLS}, {_LINES}, st AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS id, max(l_returnflag) = 'R' AS compound, min(l_suppkey) % 3 AS depth, min(l_partkey % 20) AS a, min(l_partkey % 20) + min(l_suppkey) % 5 AS z FROM lineitem GROUP BY 1, 2),
        su AS (SELECT DISTINCT c.sample, c.s, line FROM c JOIN l ON l.sample = c.sample AND l.b = c.b WHERE c.m > 5), h AS (SELECT su.sample, su.s, id, compound, depth, z - a AS span, count(*) AS support FROM su JOIN st ON st.sample = su.sample AND line BETWEEN a AND z GROUP BY ALL)
        SELECT sample, s, id, support FROM h QUALIFY row_number() OVER (PARTITION BY sample, s ORDER BY compound, support DESC, depth DESC, span, id) = 1""",
    "region_mask": f"WITH {_CELLS} SELECT sample, b % 2 AS region, s // 3 AS s_region, round(sum(m), 6) AS mass FROM c GROUP BY 1, 2, 3 HAVING sum(m) > 30",
    "best_source_index": "WITH k AS (SELECT lang AS key, doc_id, source FROM documents UNION ALL SELECT source, doc_id, source FROM documents) SELECT key, arg_max(doc_id, (source > 'src5', doc_id)) AS doc_id FROM k GROUP BY 1",
    "primary_file": "WITH k AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_max(l_returnflag, (n, -f, l_returnflag)) AS l_returnflag FROM k GROUP BY 1",
    "outline_levels": "SELECT l_orderkey, l_quantity, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS level FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem)",
    "agreement_rates": "SELECT l_linestatus, count(*) AS n_both, round(count(*) FILTER (l_returnflag = 'N') / count(*), 6) AS agree, round(count(*) FILTER (l_returnflag = 'A') / count(*), 6) AS near FROM lineitem GROUP BY 1",
    "signal_means": "WITH s AS (SELECT count(*) AS b, count(*) FILTER (l_returnflag = 'N') AS a, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n_samples, round(avg(b), 6) AS n_both, round(avg(a), 6) AS n_agree, round(avg(n), 6) AS n_near FROM s",
    "verdict_packing": """WITH o AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'x' WHEN o_totalprice <= 50000 THEN 'p' WHEN CAST(o_orderpriority[1] AS INTEGER) < 3 THEN 't' ELSE 'a' END AS r, CAST(o_orderpriority[1] AS INTEGER) AS t FROM orders)
        SELECT o_custkey, count(*) FILTER (r = 'a') AS accepted, count(*) FILTER (r = 'x') AS not_opted_in, count(*) FILTER (r = 'p') AS not_passed, count(*) FILTER (r = 't') AS below_tier, max(t) FILTER (r = 'a') AS best_tier FROM o GROUP BY 1""",
    "evidence_split": "WITH k AS (SELECT bool_or(l_returnflag = 'R') AS s FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT count(*) FILTER (s) AS strict, count(*) FILTER (NOT s) AS contract_backed FROM k",
    "structure_grades": """WITH k AS (SELECT l_orderkey, max(l_returnflag) = 'R' AS bad, avg(l_discount) * 4 > 0.2 AS e, avg(l_tax) * 20 < 0.7 AS o, coalesce(avg(l_quantity / 30) FILTER (l_discount > 0), 0) < 0.8 AS c FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CASE WHEN bad THEN 'FAIL' WHEN e OR o OR c THEN 'WARN' ELSE 'OK' END AS grade, concat_ws(',', CASE WHEN bad THEN 'lines_without_mass' END, CASE WHEN e THEN 'empty_blocks' END, CASE WHEN o THEN 'order' END, CASE WHEN c THEN 'coverage' END) AS notes FROM k""",
    "test_vectors": """
        WITH p AS (SELECT (a.x + 2) * 5 + b.x + 2 AS o, a.x || ',' || b.x AS vec FROM range(-2, 3) a(x), range(-2, 3) b(x)),
             e AS (SELECT 25 + i AS o, CASE WHEN i % 2 = 0 THEN v || ',0' ELSE '0,' || v END AS vec FROM (SELECT unnest([-9223372036854775807, -17, -3, -2, -1, 0, 1, 2, 3, 17, 9223372036854775807]) AS v, unnest(range(11)) AS i)),
             f AS (SELECT vec, min(o) AS o FROM (SELECT * FROM p UNION ALL SELECT * FROM e) GROUP BY 1), n AS (SELECT count(*) AS n FROM f),
             g AS (SELECT i, list_transform([1, 2], lambda k: CAST(('0x' || substr(md5('seed:' || i || ':' || k), 1, 12)) AS BIGINT) % 200001 - 100000) AS v FROM n, range(n.n, 120) t(i)),
             x AS (SELECT row_number() OVER (ORDER BY o) - 1 AS case_id, vec FROM f UNION ALL SELECT i, array_to_string(v, ',') FROM g)
        SELECT min(case_id) AS case_id, vec FROM x GROUP BY vec ORDER BY case_id LIMIT 60""",
    "pattern_reliability": "WITH r AS (SELECT l_orderkey, 0.2 + l_quantity / 100 AS p, CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 1.0 END AS w FROM lineitem) SELECT l_orderkey, round(sqrt(least(1, exp(sum(ln(p) * w) / sum(w))) * 0.875), 6) AS reliability FROM r GROUP BY 1",
    "region_infonce": f"WITH {_SIM}, z AS (SELECT *, sim - (max(sim) OVER r + ln(sum(exp(sim)) OVER r) - max(sim) OVER r) AS lp FROM s WINDOW r AS (PARTITION BY label, a)), q AS (SELECT label, a, -avg(lp) FILTER (abs(a - b) <= 10) AS l FROM z GROUP BY 1, 2) SELECT label, round(avg(coalesce(l, 0)), 6) AS loss FROM q GROUP BY 1",
    "neighbour_loss": f"WITH {_SIM}, z AS (SELECT *, sim - ln(sum(exp(sim)) OVER (PARTITION BY label, a)) AS lp FROM s WHERE a <> b) SELECT label, round(-avg(lp), 6) AS loss FROM z WHERE b > a AND b <= a + 20 GROUP BY 1",
    "plan_error": f"WITH {_SIM}, t AS (SELECT label, a, b, CASE WHEN a = b THEN 3.0 ELSE 1.0 END AS m FROM s WHERE b = a OR b = a + 10), u AS (SELECT *, m / sum(m) OVER (PARTITION BY label, a) AS t FROM t), z AS (SELECT label, a, b, exp(sim) / sum(exp(sim)) OVER (PARTITION BY label, a) AS p FROM s) SELECT label, round(avg(pow(p - coalesce(u.t, 0), 2)), 6) AS loss FROM z LEFT JOIN u USING (label, a, b) GROUP BY 1",
    "hard_negative_loss": f"""WITH {_SIM}, d AS (SELECT label, 'a' AS side, a AS i, b AS j, sim, b - a BETWEEN 0 AND 10 AS pos FROM s UNION ALL SELECT label, 'b', b, a, sim, b - a BETWEEN 0 AND 10 FROM s),
        n AS (SELECT label, side, i, sum(exp(sim)) AS n FROM (SELECT * FROM d WHERE NOT pos QUALIFY row_number() OVER (PARTITION BY label, side, i ORDER BY sim DESC) <= 5) GROUP BY 1, 2, 3), p AS (SELECT label, side, i, sum(exp(sim)) AS p FROM d WHERE pos GROUP BY 1, 2, 3)
        SELECT label, round(avg(ln(p + n) - ln(p)), 6) AS loss, count(*) AS n_rows FROM n JOIN p USING (label, side, i) GROUP BY 1""",
}

"""Queries on joins and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import align as L
from loomspark.operators import joins as J
from loomspark.operators.settle import settled

from .tables import by_order, read


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Alignment cells out of line items: order, line, supplier's residue class, quantity and discount."""
    return by_order(spark, d).groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("b"), (F.col("l_suppkey") % 8).alias("s")).agg(F.sum("l_quantity").alias("m"), F.max(F.col("l_discount") * 10).alias("w"))


def _blocks(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample").agg(F.max("b").alias("n_b"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def interval_join_prefer_flag(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("long"))
    blocks = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("block"), F.col("us").alias("low"), (F.col("us") + 21_600_000_000).alias("high"))
    found = J.interval_join(e.select("user_id", "event_id", "event_type", "us"), blocks, ["user_id"], "us", "low", "high", 21_600_000_000)
    return J.prefer_flagged(found, ["user_id", "block"], F.col("event_type") == "purchase").select("user_id", "block", "event_id", "event_type")


def overlap_join_widen(spark: SparkSession, d: str) -> DataFrame:
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), days("o_orderdate").alias("low"), (days("o_orderdate") + 5).alias("high"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", days("l_shipdate").alias("start"), (days("l_shipdate") + 2).alias("end")).distinct()
    return J.overlap_or_widened(orders, lines, ["k"], "low", "high", "start", "end", 15, 32).groupBy("k").agg(F.count("*").alias("n"), F.bool_or("widened").alias("widened"))


def jaccard_argmax_match(spark: SparkSession, d: str) -> DataFrame:
    words = lambda df, k: df.select(k, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''")
    return J.jaccard_argmax(words(read(spark, d, "benchmark"), "item_id"), words(read(spark, d, "documents"), "doc_id"), "item_id", "doc_id", "w", 0.1)


def cascading_key_join(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read(spark, d, "labels").select(F.col("doc_id").alias("label_id")).join(docs.select(F.col("doc_id").alias("label_id"), F.col("n_chars").alias("label_chars"), F.col("lang").alias("label_lang")), "label_id")
    keys = [("id", F.col("doc_id"), F.col("label_id")), ("length", F.col("n_chars"), F.col("label_chars"))]
    return J.cascade(docs, lab, keys, "doc_id", "label_id", F.col("lang") == F.col("label_lang")).select("doc_id", "label_id", "method")


def overlay_enrichment(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    extra = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.lit("tox")).otherwise("").alias("source"), F.lit(None).cast("string").alias("lang"))
    return J.overlay(docs, extra, "doc_id", ["source", "lang"])


def overlay_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The same where only empty values are filled, with a record of the repair."""
    docs = read(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"))
    extra = read(spark, d, "labels").select("doc_id", F.concat(F.lit("label"), F.col("quality").cast("string")).alias("source"), F.lit("zz").alias("lang"))
    return J.with_repair(docs, J.overlay(docs, extra, "doc_id", ["source", "lang"], keep_filled=True), "doc_id", ["source", "lang"], "fill_v1").select("doc_id", "lang", "source", "repair.version", "repair.n_changed")


def item_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 5)).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey") % 5)).alias("b"))
    return rows.select("l_orderkey", F.round(J.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def first_match_join(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").select("n_nationkey", "n_name")
    build = read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_name")
    return J.first_match(nations, build, "n_nationkey", "c_custkey", ["c_custkey", "c_name"])


def companion_self_join(spark: SparkSession, d: str) -> DataFrame:
    return J.companion(read(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", "7").select("vec_id", "label", "companion")


def slot_coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    key = lines.select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("slot"), "l_returnflag", "l_linestatus", "l_discount")
    stages = {"candidates": key.where("l_returnflag <> 'N'"), "train": key.where("l_linestatus = 'F'"), "decode": key.where("l_discount > 0.05")}
    return J.coverage(key, stages, ["f", "slot"])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of users: an edge for each step from an event to the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return _events(spark, d).withColumns({"dst": F.lead("event_type").over(w), "n": F.row_number().over(w)}).where("dst IS NOT NULL").select("user_id", F.col("event_type").alias("src"), "dst", F.when(F.col("n") == 1, "entry").otherwise("step").alias("etype"), "n")


def project_edges(spark: SparkSession, d: str) -> DataFrame:
    place = _events(spark, d).groupBy("user_id", F.col("event_type").alias("node")).agg((F.count("*") % 3).alias("to"))
    return J.projected_edges(_edges(spark, d), place, ["user_id"], "n")


def edge_prf(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    half = F.col("n") <= 30
    return J.edge_scores(e.where(half), e.where(~half), ["user_id"])


def multiset_f1(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return J.multiset_f1(e.where("src = 'click'"), e.where("src = 'view'"), ["user_id"], "dst")


def align_row_normalise(spark: SparkSession, d: str) -> DataFrame:
    return L.row_normalised(_cells(spark, d)).select("sample", "b", "s", F.round("m", 6).alias("m"))


def argmax_primary(spark: SparkSession, d: str) -> DataFrame:
    return L.primary(_cells(spark, d)).select("sample", "b", "s", "m")


def topk_peak_fraction(spark: SparkSession, d: str) -> DataFrame:
    return L.top_by_peak(_cells(spark, d)).select("sample", "b", "s", "m", F.col("place").cast("long").alias("place"))


def _block_edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge from every block to the next number, conditional where the first supplier's number is even."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("src")).agg((F.min("l_suppkey") % 2).alias("etype"))
    return rows.select("sample", "src", (F.col("src") + 1).alias("dst"), "etype")


def align_metrics_macro(spark: SparkSession, d: str) -> DataFrame:
    cells = settled(_cells(spark, d))
    per = L.metrics(cells, _blocks(cells), _block_edges(spark, d))
    return per.agg(F.count("*").alias("n_samples"), *[F.round(F.avg(c), 4).alias(c) for c in ("coverage", "mean_conf", "high", "low", "in_order", "control_flow")])


def onehot_multi_empty(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return L.row_shapes(cells, _blocks(cells))


def jumps(spark: SparkSession, d: str) -> DataFrame:
    return L.jumps(L.primary(_cells(spark, d)))


def column_compaction(spark: SparkSession, d: str) -> DataFrame:
    return L.compacted(_cells(spark, d), least=10.0).select("sample", "b", "s", F.col("column").cast("long").alias("column"))


def expected_position(spark: SparkSession, d: str) -> DataFrame:
    return L.expected_position(_cells(spark, d))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Two statements per block, with lines and confidences; either may be missing."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("b")).agg(
        F.when(F.max("l_returnflag") != "A", F.min("l_suppkey") % 8).alias("first"), (F.min("l_discount") * 10).alias("first_conf"), F.when(F.min("l_tax") > 0, F.min("l_partkey") % 8).alias("second"), (F.min("l_tax") * 10).alias("second_conf"))
    return rows.withColumns({f"{x}_{e}": F.col(x) * 3 + (F.col(x) % 4 if e == "end" else 0) for x in ("first", "second") for e in ("start", "end")})


def two_signal_fusion(spark: SparkSession, d: str) -> DataFrame:
    return L.fused(_signals(spark, d)).select("sample", "b", "s", "m", F.round("w", 6).alias("w"))


def signal_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.signal_stats(_signals(spark, d))


def line_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey") % 6)).alias("a"), F.collect_list(F.when(F.col("l_linestatus") == "F", F.col("l_partkey") % 6)).alias("b"), (F.min("l_discount") * 10).alias("z"))
    x = rows.select("l_orderkey", L.fused_lines(F.col("a"), F.col("b"), F.col("z")).alias("x"))
    return x.select("l_orderkey", F.array_join("x.lines", ",").alias("lines"), F.round("x.confidence", 6).alias("confidence"))


def _some_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of all blocks; cells where a discount was given, of mass 0 for returned items; orders."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("b"), (F.col("l_partkey") % 20).alias("line"), (F.col("l_suppkey") % 8).alias("s"), "l_discount", F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("m"))
    return rows.select("sample", "b", "line"), rows.where("l_discount > 0.05").select("sample", "b", "s", "m"), rows.select("sample").distinct()


def supported_lines(spark: SparkSession, d: str) -> DataFrame:
    lines, cells, _ = _some_cells(spark, d)
    return L.supported_lines(lines, cells)


def lines_consistent(spark: SparkSession, d: str) -> DataFrame:
    return L.lines_consistent(*_some_cells(spark, d))


def align_weights_normalised(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_discount") - 0.02).alias("weight"))
    return L.weights_normalised(rows, ["l_orderkey"], "weight")


def weighted_kl(spark: SparkSession, d: str) -> DataFrame:
    """Against a prediction that knows only statements of odd number; blocks without any are compared with the uniform one."""
    cells = settled(_cells(spark, d))
    predicted = cells.where("s % 2 = 1").select("sample", "b", "s", (F.col("s") + 1).cast("double").alias("m"))
    shapes = cells.groupBy("sample").agg(F.max("b").alias("n_b"), F.lit(8).cast("long").alias("n_s"))
    return L.weighted_kl(cells, predicted, shapes)


def edge_recovery_kl(spark: SparkSession, d: str) -> DataFrame:
    cells = settled(L.row_normalised(_cells(spark, d)))
    blocks = cells.select("sample", "b").distinct()
    edges = blocks.join(blocks.select("sample", (F.col("b") - 1).alias("b"), F.lit(1).alias("one")), ["sample", "b"]).select("sample", F.col("b").alias("src"), (F.col("b") + 1).alias("dst"))
    s = L.primary(cells).select("sample", "b", "s")
    source = s.join(s.select("sample", (F.col("b") - 1).alias("b"), F.col("s").alias("j")), ["sample", "b"]).select("sample", F.col("s").alias("i"), "j").distinct()
    edges = edges.where("src % 2 = 1")  # samples without any have no predicted mass
    return L.edge_recovery(cells, edges, source).agg(F.count("*").alias("n"), F.round(F.avg("loss"), 4).alias("mean_loss"))


def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.gap_clusters(_events(spark, d), ["user_id"], "us", 43_200_000_000).groupBy("user_id").agg((F.max("cluster") + 1).alias("n_clusters"))


def canonical_header(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_returnflag").alias("flag"))
    return L.canonical(rows, ["l_orderkey", "l_linenumber"], F.col("flag") == "R", "l_partkey")


QUERIES = {
    f.__name__: f
    for f in (
        interval_join_prefer_flag, overlap_join_widen, jaccard_argmax_match, cascading_key_join, overlay_enrichment, overlay_backfill, item_jaccard, first_match_join, companion_self_join, slot_coverage, project_edges, edge_prf, multiset_f1,
        align_row_normalise, argmax_primary, topk_peak_fraction, align_metrics_macro, onehot_multi_empty, jumps, column_compaction, expected_position, two_signal_fusion, signal_stats, line_fusion, supported_lines, lines_consistent, align_weights_normalised, weighted_kl, edge_recovery_kl, gap_clusters, canonical_header,
    )
}

_CELLS = "c AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS b, l_suppkey % 8 AS s, sum(l_quantity) AS m, max(l_discount * 10) AS w FROM lineitem GROUP BY 1, 2, 3)"
_NB = "nb AS (SELECT sample, max(b) AS n_b FROM c GROUP BY 1)"
_PRIMARY = "p AS (SELECT * FROM c WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY sample, b ORDER BY m DESC, s) = 1)"
_STEPS = "st AS (SELECT x.sample, x.b, y.s - x.s AS step FROM p x JOIN p y ON x.sample = y.sample AND y.b = x.b + 1)"
_NORM = "n AS (SELECT sample, b, s, m / sum(m) OVER (PARTITION BY sample, b) AS m, w FROM c)"
_EDGES = "e AS (SELECT * FROM (SELECT user_id, event_type AS src, lead(event_type) OVER o AS dst, CASE WHEN row_number() OVER o = 1 THEN 'entry' ELSE 'step' END AS etype, row_number() OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dst IS NOT NULL)"
_SIGNALS = """g AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS b, CASE WHEN max(l_returnflag) <> 'A' THEN min(l_suppkey) % 8 END AS a, min(l_discount) * 10 AS ca, CASE WHEN min(l_tax) > 0 THEN min(l_partkey) % 8 END AS z, min(l_tax) * 10 AS cb FROM lineitem GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN a IS NULL AND z IS NULL THEN 'none' WHEN z IS NULL THEN 'first_only' WHEN a IS NULL THEN 'second_only' WHEN a = z THEN 'agree'
          WHEN len(list_intersect(range(a * 3, a * 3 + a % 4 + 1), range(z * 3, z * 3 + z % 4 + 1))) > 0 OR abs(a * 3 - z * 3) <= 2 THEN 'near' ELSE 'conflict' END AS kind FROM g)"""
_SOME = "r AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS b, l_partkey % 20 AS line FROM lineitem), x AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS b, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m FROM lineitem WHERE l_discount > 0.05)"
ORACLES = {
    "interval_join_prefer_flag": """
        WITH f AS (SELECT e.user_id, b.event_id AS block, e.event_id, e.event_type FROM events b JOIN events e ON e.user_id = b.user_id AND b.event_type = 'signup' AND e.ts >= b.ts AND e.ts < b.ts + INTERVAL 6 HOUR)
        SELECT * FROM f QUALIFY event_type = 'purchase' OR NOT bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, block)""",
    "overlap_join_widen": """
        WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber, CAST(l_shipdate AS DATE) AS s FROM lineitem), o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
             x AS (SELECT k, NOT (s <= d + 5 AND s + 2 >= d) AS widened FROM o JOIN l USING (k) WHERE s <= d + 20 AND s + 2 >= d - 15),
             y AS (SELECT k, widened FROM x QUALIFY NOT widened OR bool_and(widened) OVER (PARTITION BY k))
        SELECT k, count(*) AS n, bool_or(widened) AS widened FROM y GROUP BY k""",
    "jaccard_argmax_match": """
        WITH a AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
             na AS (SELECT item_id, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT doc_id, count(*) AS nb FROM b GROUP BY 1),
             i AS (SELECT item_id, doc_id, count(*) AS i FROM a JOIN b USING (w) GROUP BY 1, 2)
        SELECT item_id, doc_id, round(i / (na + nb - i), 6) AS jaccard FROM i JOIN na USING (item_id) JOIN nb USING (doc_id) WHERE i / (na + nb - i) >= 0.1
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i / (na + nb - i) DESC, doc_id) = 1""",
    "cascading_key_join": """
        WITH l AS (SELECT doc_id AS label_id, n_chars, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
             x AS (SELECT d.doc_id, l.label_id, 0 AS r, 'id' AS method FROM documents d JOIN l ON l.label_id = d.doc_id AND l.lang = d.lang UNION ALL
                   SELECT d.doc_id, l.label_id, 1, 'length' FROM documents d JOIN l ON l.n_chars = d.n_chars AND l.lang = d.lang),
             y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r, label_id) = 1)
        SELECT doc_id, label_id, method FROM documents LEFT JOIN y USING (doc_id)""",
    "overlay_enrichment": "SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'tox' ELSE source END AS source FROM documents LEFT JOIN labels USING (doc_id)",
    "overlay_backfill": """WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source FROM documents)
        SELECT doc_id, CASE WHEN coalesce(d.lang, '') = '' AND l.doc_id IS NOT NULL THEN 'zz' ELSE d.lang END AS lang, CASE WHEN coalesce(source, '') = '' AND l.doc_id IS NOT NULL THEN 'label' || quality ELSE source END AS source, 'fill_v1' AS version,
               CAST((coalesce(source, '') = '' AND l.doc_id IS NOT NULL)::INT + (coalesce(d.lang, '') = '' AND l.doc_id IS NOT NULL)::INT AS INTEGER) AS n_changed FROM d LEFT JOIN labels l USING (doc_id)""",
    "item_jaccard": """WITH k AS (SELECT l_orderkey, list(DISTINCT l_suppkey % 5) FILTER (l_returnflag = 'R') AS a, list(DISTINCT l_suppkey % 5) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY 1), c AS (SELECT l_orderkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM k)
        SELECT l_orderkey, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM c""",
    "first_match_join": "SELECT n_nationkey, n_name, min(c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "companion_self_join": """
        SELECT vec_id, label, coalesce(lead(vec_id) OVER o, first_value(vec_id) OVER o) AS companion FROM embeddings WINDOW o AS (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id)""",
    "slot_coverage": """
        WITH k AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag <> 'N') AS a, bool_or(l_linestatus = 'F') AS b, bool_or(l_discount > 0.05) AS c FROM lineitem GROUP BY 1, 2)
        SELECT stage, count(*) AS expected, count(*) FILTER (hit) AS covered, round(count(*) FILTER (hit) / count(*), 6) AS ratio
        FROM (SELECT 'candidates' AS stage, a AS hit FROM k UNION ALL SELECT 'train', b FROM k UNION ALL SELECT 'decode', c FROM k) GROUP BY stage""",
    "project_edges": f"""
        WITH {_EDGES}, p AS (SELECT user_id, event_type AS node, count(*) % 3 AS t FROM events GROUP BY 1, 2)
        SELECT e.user_id, a.t AS src, b.t AS dst, arg_min(etype, n) AS etype FROM e JOIN p a ON a.user_id = e.user_id AND a.node = src JOIN p b ON b.user_id = e.user_id AND b.node = dst WHERE a.t <> b.t GROUP BY 1, 2, 3""",
    "edge_prf": f"""
        WITH {_EDGES}, g AS (SELECT DISTINCT user_id, src, dst FROM e WHERE n <= 30), f AS (SELECT DISTINCT user_id, src, dst FROM e WHERE n > 30),
             s AS (SELECT coalesce(g.user_id, f.user_id) AS user_id, count(g.src) AS g, count(f.src) AS f, count(*) FILTER (g.src IS NOT NULL AND f.src IS NOT NULL) AS b FROM g FULL JOIN f ON g.user_id = f.user_id AND g.src = f.src AND g.dst = f.dst GROUP BY 1)
        SELECT user_id, round(coalesce(b / nullif(f, 0), 0), 6) AS precision, round(coalesce(b / nullif(g, 0), 0), 6) AS recall, round(coalesce(2 * b / nullif(f + g, 0), 0), 6) AS f1 FROM s""",
    "multiset_f1": f"""
        WITH {_EDGES}, x AS (SELECT user_id, dst, count(*) FILTER (src = 'click') AS x, count(*) FILTER (src = 'view') AS y FROM e WHERE src IN ('click', 'view') GROUP BY 1, 2)
        SELECT user_id, round(2 * sum(least(x, y)) / sum(x + y), 6) AS f1 FROM x GROUP BY 1""",
    "align_row_normalise": f"WITH {_CELLS}, {_NORM} SELECT sample, b, s, round(m, 6) AS m FROM n",
    "argmax_primary": f"WITH {_CELLS}, {_PRIMARY} SELECT sample, b, s, m FROM p",
    "topk_peak_fraction": f"WITH {_CELLS}, x AS (SELECT *, max(m) OVER (PARTITION BY sample, b) AS k FROM c), y AS (SELECT sample, b, s, m, row_number() OVER (PARTITION BY sample, b ORDER BY m DESC, s DESC) AS place FROM x WHERE m >= k * 0.5) SELECT * FROM y WHERE place <= 3",
    "align_metrics_macro": f"""
        WITH {_CELLS}, {_NB}, {_PRIMARY}, {_STEPS},
             a AS (SELECT sample, count(DISTINCT b) FILTER (m > 0) AS covered, avg(w) FILTER (w > 0) AS conf, count(*) FILTER (w > 0.7) / nullif(count(*) FILTER (w > 0), 0) AS high, count(*) FILTER (w > 0 AND w < 0.3) / nullif(count(*) FILTER (w > 0), 0) AS low FROM c GROUP BY 1),
             o AS (SELECT sample, avg(CASE WHEN step >= -2 THEN 1.0 ELSE 0.0 END) AS in_order FROM st GROUP BY 1),
             e AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS src FROM lineitem GROUP BY 1, 2 HAVING min(l_suppkey) % 2 = 0),
             f AS (SELECT e.sample, avg(CASE WHEN x.s <> y.s THEN 1.0 ELSE 0.0 END) AS control_flow FROM e JOIN p x ON x.sample = e.sample AND x.b = src JOIN p y ON y.sample = e.sample AND y.b = src + 1 GROUP BY 1)
        SELECT count(*) AS n_samples, round(avg(round(coalesce(covered / n_b, 0), 6)), 4) AS coverage, round(avg(round(coalesce(conf, 0), 6)), 4) AS mean_conf, round(avg(round(coalesce(high, 0), 6)), 4) AS high, round(avg(round(coalesce(low, 0), 6)), 4) AS low,
               round(avg(round(coalesce(in_order, 1), 6)), 4) AS in_order, round(avg(round(coalesce(control_flow, 1), 6)), 4) AS control_flow FROM nb LEFT JOIN a USING (sample) LEFT JOIN o USING (sample) LEFT JOIN f USING (sample)""",
    "onehot_multi_empty": f"""
        WITH {_CELLS}, {_NB}, k AS (SELECT sample, b, count(*) AS k FROM c WHERE m > 0.01 GROUP BY 1, 2), r AS (SELECT sample, count(*) FILTER (k = 1) AS one, count(*) FILTER (k > 1) AS many FROM k GROUP BY 1)
        SELECT sample, round(coalesce(one, 0) / n_b, 6) AS one_hot, round(coalesce(many, 0) / n_b, 6) AS multi, round((n_b - coalesce(one, 0) - coalesce(many, 0)) / n_b, 6) AS empty FROM nb LEFT JOIN r USING (sample)""",
    "jumps": f"WITH {_CELLS}, {_PRIMARY}, {_STEPS} SELECT sample, count(*) FILTER (step < -2) AS n_jumps, max(abs(step)) AS longest FROM st GROUP BY 1",
    "column_compaction": f'WITH {_CELLS}, u AS (SELECT sample, s, dense_rank() OVER (PARTITION BY sample ORDER BY s) - 1 AS "column" FROM c GROUP BY 1, 2 HAVING max(m) > 10) SELECT sample, b, s, "column" FROM c JOIN u USING (sample, s)',
    "expected_position": f"WITH {_CELLS} SELECT sample, b, round(sum(s * m) / nullif(sum(m), 0), 6) AS position FROM c GROUP BY 1, 2",
    "two_signal_fusion": f"""WITH {_SIGNALS}
        SELECT sample, b, a AS s, CAST(1 AS DOUBLE) AS m, round(least(ca + cb, 1) * CASE kind WHEN 'near' THEN 0.85 ELSE 1 END, 6) AS w FROM k WHERE kind IN ('agree', 'near') UNION ALL
        SELECT sample, b, a, 0.6, round(ca * 0.5, 6) FROM k WHERE kind = 'conflict' UNION ALL SELECT sample, b, z, 0.4, round(cb * 0.5, 6) FROM k WHERE kind = 'conflict' UNION ALL
        SELECT sample, b, coalesce(a, z), 1.0, round(0.8 * CASE WHEN a IS NULL THEN cb ELSE ca END, 6) FROM k WHERE kind LIKE '%only'""",
    "signal_stats": f"WITH {_SIGNALS} SELECT sample, count(*) FILTER (a IS NOT NULL AND z IS NOT NULL) AS n_both, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in L.KINDS)} FROM k GROUP BY 1",
    "line_fusion": """
        WITH l AS (SELECT l_orderkey, list_sort(list_distinct(coalesce(list(l_suppkey % 6) FILTER (l_returnflag <> 'R'), []))) AS a, list_sort(list_distinct(coalesce(list(l_partkey % 6) FILTER (l_linestatus = 'F'), []))) AS b, min(l_discount) * 10 AS z FROM lineitem GROUP BY 1),
             i AS (SELECT *, list_sort(list_intersect(a, b)) AS i FROM l),
             k AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN CASE WHEN a = b THEN 1 WHEN len(i) > 0 AND len(i) >= len(a) * 0.5 THEN 2 ELSE 3 END WHEN len(a) > 0 THEN 4 WHEN len(b) > 0 THEN 5 ELSE 6 END AS k FROM i)
        SELECT l_orderkey, array_to_string(CASE WHEN k IN (1, 4, 6) THEN a WHEN k = 2 THEN i ELSE b END, ',') AS lines,
               round(CASE k WHEN 1 THEN least(1, 0.7 + 0.3 * z) WHEN 2 THEN len(i) / greatest(len(a), len(b)) WHEN 3 THEN 0.5 + 0.3 * z WHEN 4 THEN 0.8 WHEN 5 THEN 0.6 + 0.2 * z END, 6) AS confidence FROM k""",
    "supported_lines": f"WITH {_SOME} SELECT sample, b, line FROM r WHERE (sample, b) IN (SELECT (sample, b) FROM x WHERE m > 0) OR sample NOT IN (SELECT sample FROM x)",
    "lines_consistent": f"WITH {_SOME} SELECT sample, bool_and((sample, b) IN (SELECT (sample, b) FROM x WHERE m > 0)) AS consistent FROM r GROUP BY 1",
    "align_weights_normalised": "WITH w AS (SELECT l_orderkey, l_linenumber, min(l_discount) - 0.02 AS weight FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(greatest(weight, 0)) OVER (PARTITION BY l_orderkey) AS t FROM w) SELECT l_orderkey, l_linenumber, CASE WHEN t > 0 THEN round(greatest(weight, 0) / t, 8) ELSE weight END AS weight FROM t",
    "weighted_kl": f"""
        WITH {_CELLS}, {_NORM}, q AS (SELECT sample, b, s, (s + 1) / sum(s + 1) OVER (PARTITION BY sample, b) AS q FROM n WHERE s % 2 = 1),
             k AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM q o WHERE o.sample = n.sample AND o.b = n.b) THEN greatest(coalesce(q, 0), 1e-8) ELSE 1 / 8 END AS p FROM n LEFT JOIN q USING (sample, b, s))
        SELECT sample, round(coalesce(sum(w * m * (ln(m) - ln(p))), 0) / max(b), 6) AS loss FROM k GROUP BY 1""",
    "edge_recovery_kl": f"""
        WITH {_CELLS}, {_NORM}, bl AS (SELECT DISTINCT sample, b FROM n), e AS (SELECT x.sample, x.b AS src, x.b + 1 AS dst FROM bl x JOIN bl y ON x.sample = y.sample AND y.b = x.b + 1 WHERE x.b % 2 = 1),
             pp AS (SELECT e.sample, i.s AS i, j.s AS j, sum(i.m * j.m) AS p FROM e JOIN n i ON i.sample = e.sample AND i.b = src JOIN n j ON j.sample = e.sample AND j.b = dst GROUP BY 1, 2, 3),
             p AS (SELECT sample, i, j, p / sum(p) OVER (PARTITION BY sample) AS p FROM pp),
             pr AS (SELECT * FROM n WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY sample, b ORDER BY m DESC, s) = 1),
             q0 AS (SELECT DISTINCT x.sample, x.s AS i, y.s AS j FROM pr x JOIN pr y ON x.sample = y.sample AND y.b = x.b + 1), q AS (SELECT *, 1 / count(*) OVER (PARTITION BY sample) AS q FROM q0),
             l AS (SELECT q.sample, round(CASE WHEN q.sample IN (SELECT sample FROM pp) THEN least(sum(q * ln(q / greatest(coalesce(p, 0), 1e-8))), 1000) ELSE count(*) * count(*) END, 6) AS loss FROM q LEFT JOIN p USING (sample, i, j) GROUP BY 1)
        SELECT count(*) AS n, round(avg(loss), 4) AS mean_loss FROM l""",
    "gap_clusters": "WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS g FROM events) SELECT user_id, CAST(sum(g) + 1 AS BIGINT) AS n_clusters FROM g GROUP BY 1",
    "canonical_header": """
        WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2, 3)
        SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY flag <> 'R', l_partkey) = 1""",
}

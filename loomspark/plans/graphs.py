"""Queries on graphs: each user's events are a graph over event types, entered at the first event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import graph as G
from loomspark.operators import labels as L

from .joining import _EDGES, _edges, _events

TYPES = ["click", "error", "purchase", "signup", "view"]


def _number(c: str):
    return (F.array_position(F.array(*map(F.lit, TYPES)), F.col(c)) - 1).cast("long")


def _graphs(spark: SparkSession, d: str, steps: int | None = None, branches: bool = False) -> DataFrame:
    """With `steps` only a user's first steps make edges, so that there are exits; with `branches` each of these events leads to the one after the next, too, so that there are cycles of two entries."""
    e = _edges(spark, d).select("user_id", "src", "dst", "n")
    if branches:
        w = Window.partitionBy("user_id").orderBy("us", "event_id")
        skip = _events(spark, d).withColumns({"dst": F.lead("event_type", 2).over(w), "n": F.row_number().over(w)}).where("dst IS NOT NULL")
        e = e.unionByName(skip.select("user_id", F.col("event_type").alias("src"), "dst", "n"))
    e = e.where(F.col("n") <= steps) if steps else e
    edges = e.select(F.col("user_id").alias("sample"), _number("src").alias("src"), _number("dst").alias("dst"))
    first = _events(spark, d).groupBy(F.col("user_id").alias("sample")).agg(F.min_by("event_type", F.struct("us", "event_id")).alias("t"))
    return G.gathered(edges, first.select("sample", _number("t").alias("entry")))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).select(F.col("user_id").alias("sample"), _number("src").alias("src"), _number("dst").alias("dst"))
    return G.degrees(edges)


def reachability(spark: SparkSession, d: str) -> DataFrame:
    return G.per_graph(_graphs(spark, d), lambda e, n, x: [(m,) for m in sorted(G.reachable([e], G.adjacency(n, x)[0]))], "node bigint")


def dominators(spark: SparkSession, d: str) -> DataFrame:
    def kernel(e, n, x):
        out, into = G.adjacency(n, x)
        idom = G.immediate_dominators(e, out, into)
        return [(a, b) for b in sorted(G.reachable([e], out)) for a in n if G.dominates(idom, a, b)]

    return G.per_graph(_graphs(spark, d), kernel, "dom bigint, node bigint")


def immediate_dominators(spark: SparkSession, d: str) -> DataFrame:
    return G.per_graph(_graphs(spark, d), lambda e, n, x: sorted(G.immediate_dominators(e, *G.adjacency(n, x)).items()), "node bigint, idom bigint")


def post_dominators(spark: SparkSession, d: str) -> DataFrame:
    def kernel(e, n, x):
        out, into = G.adjacency(n, x)
        return [(v, a, b) for v in ("all", "first") for a, b in sorted(G.post_dominators(n, out, into, v).items())]

    return G.per_graph(_graphs(spark, d, 3, True), kernel, "variant string, node bigint, post bigint")


def loop_headers(spark: SparkSession, d: str) -> DataFrame:
    return G.per_graph(_graphs(spark, d), lambda e, n, x: [(h,) for h in sorted(G.loops(e, n, x))], "header bigint")


def loop_bodies(spark: SparkSession, d: str) -> DataFrame:
    return G.per_graph(_graphs(spark, d), lambda e, n, x: [(h, m) for h, b in sorted(G.loops(e, n, x).items()) for m in sorted(b)], "header bigint, node bigint")


def scc(spark: SparkSession, d: str) -> DataFrame:
    return G.per_graph(_graphs(spark, d), lambda e, n, x: [(m, p[0]) for p in G.strong_components(n, G.adjacency(n, x)[0]) for m in p], "node bigint, component bigint")


def irreducible_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.per_graph(_graphs(spark, d, 4, True), lambda e, n, x: [(p[0], len(p)) for p in G.irreducible(e, n, x)], "first_node bigint, size bigint")


def label_components(spark: SparkSession, d: str) -> DataFrame:
    def kernel(e, n, x):
        return sorted(G.label_regions(n, x, {m: m % 2 for m in n}).items())

    return G.per_graph(_graphs(spark, d), kernel, "node bigint, region bigint")


def bfs_dfs_positions(spark: SparkSession, d: str) -> DataFrame:
    def kernel(e, n, x):
        dfs, bfs, _ = G.traversal(e, n, G.adjacency(n, x)[0])
        last = max(len(n) - 1, 1)
        return [(m, dfs[m] / last, bfs[m] / last) for m in n]

    return G.per_graph(_graphs(spark, d, 3, True), kernel, "node bigint, dfs double, bfs double")


def sese_regions(spark: SparkSession, d: str) -> DataFrame:
    return G.per_graph(_graphs(spark, d, 3, True), lambda e, n, x: [(k, m) for k, r in enumerate(G.single_entry_exit(e, n, x)) for m in r], "region bigint, node bigint")


def binary_regions(spark: SparkSession, d: str) -> DataFrame:
    def kernel(e, n, x):
        return [(r, h, ",".join(map(str, ns))) for r, h, ns in G.loop_then_label_regions(e, n, x, {m: m % 2 for m in n})]

    return G.per_graph(_graphs(spark, d), kernel, "role bigint, header bigint, nodes string")


def structural_regions(spark: SparkSession, d: str) -> DataFrame:
    roles = [4, 1, 7, 0, 1]

    def kernel(e, n, x):
        return [(r, h, ",".join(map(str, ns))) for r, h, ns in G.structural_regions(e, n, x, {m: roles[m] for m in n})]

    return G.per_graph(_graphs(spark, d, 3, True), kernel, "role bigint, header bigint, nodes string")


def pattern_labels(spark: SparkSession, d: str) -> DataFrame:
    """Edges that lead to an event type before the source's in the alphabet, or to itself, are of type back."""
    kinds = _edges(spark, d).select(F.col("user_id").alias("sample"), _number("src").alias("src"), _number("dst").alias("dst")).distinct()
    kinds = kinds.withColumn("etype", F.when(F.col("dst") <= F.col("src"), 2).otherwise(0))
    blocks = kinds.select("sample", F.explode(F.array("src", "dst")).alias("b")).distinct()
    return L.assigned(blocks, kinds, loop_headers(spark, d).withColumnRenamed("header", "b"))


def block_features(spark: SparkSession, d: str) -> DataFrame:
    def kernel(e, n, x, facts):
        own = {int(f["node"]): tuple(f[c] for c in G.FACTS) for f in (facts if facts is not None else ())}
        return [(m, *f) for m, f in sorted(G.block_features(e, n, x, own).items())]

    # each event stands for an instruction of its type's block
    opcode = F.col("event_id") % 7
    instructions = _events(spark, d).select(F.col("user_id").alias("sample"), _number("event_type").alias("node"), opcode.alias("opcode"), (opcode == 0).alias("is_call"), (opcode == 1).alias("is_indirect_jump"))
    graphs = _graphs(spark, d).join(G.block_facts(instructions), "sample", "left")
    return G.per_graph(graphs, kernel, "node bigint, " + ", ".join(f"{f} double" for f in G.FEATURES), more=("facts",))


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.per_graph(_graphs(spark, d), lambda e, n, x: G.shortest_paths(n, G.adjacency(n, x)[0]), "src bigint, dst bigint, steps bigint")


QUERIES = {
    f.__name__: f
    for f in (degrees, reachability, dominators, immediate_dominators, post_dominators, loop_headers, loop_bodies, scc, irreducible_cycles, label_components, bfs_dfs_positions, sese_regions, binary_regions, structural_regions, pattern_labels, block_features, shortest_paths)
}

_T = "t AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS name, unnest(range(5)) AS id)"
_G = f"{_EDGES}, {_T}, g AS (SELECT DISTINCT user_id AS sample, a.id AS src, b.id AS dst FROM e JOIN t a ON a.name = src JOIN t b ON b.name = dst), en AS (SELECT user_id AS sample, t.id AS entry FROM (SELECT user_id, arg_min(event_type, (ts, event_id)) AS x FROM events GROUP BY 1) JOIN t ON t.name = x), nodes AS (SELECT sample, entry AS node FROM en UNION SELECT sample, src FROM g UNION SELECT sample, dst FROM g)"
_REACH = "r AS (SELECT sample, entry AS node FROM en UNION SELECT r.sample, g.dst FROM r JOIN g ON g.sample = r.sample AND g.src = r.node)"
_AVOID = "v AS (SELECT en.sample, n.node AS gone, entry AS node FROM en JOIN nodes n ON n.sample = en.sample AND n.node <> entry UNION SELECT v.sample, gone, g.dst FROM v JOIN g ON g.sample = v.sample AND g.src = v.node AND g.dst <> gone)"
_DOM = "dom AS (SELECT r.sample, n.node AS dom, r.node FROM r JOIN nodes n ON n.sample = r.sample WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.sample = r.sample AND v.gone = n.node AND v.node = r.node) AND EXISTS (SELECT 1 FROM r x WHERE x.sample = r.sample AND x.node = n.node))"
_PATH = "w AS (SELECT sample, node AS a, node AS b FROM nodes UNION SELECT w.sample, a, g.dst FROM w JOIN g ON g.sample = w.sample AND g.src = w.b)"
_BOTH = "(SELECT * FROM (SELECT user_id, event_type AS src, unnest([lead(event_type) OVER o, lead(event_type, 2) OVER o]) AS dst, row_number() OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dst IS NOT NULL AND n <= {n}) e JOIN"
_SHORT = lambda n: _G.replace("FROM e JOIN", "FROM " + _BOTH.format(n=n))
_BACK = "be AS (SELECT g.sample, g.src, g.dst FROM g JOIN dom ON dom.sample = g.sample AND dom.dom = g.dst AND dom.node = g.src)"
# what reaches an exit without going through a node: nodes behind one another, against the edges
_POST = """ex AS (SELECT 'all' AS variant, sample, node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.sample = n.sample AND g.src = n.node) UNION ALL
                   SELECT 'first', sample, min(node) FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.sample = n.sample AND g.src = n.node) GROUP BY sample),
    lv AS (SELECT variant, sample, node FROM ex UNION SELECT lv.variant, lv.sample, g.src FROM lv JOIN g ON g.sample = lv.sample AND g.dst = lv.node),
    av AS (SELECT ex.variant, ex.sample, n.node AS gone, ex.node FROM ex JOIN nodes n ON n.sample = ex.sample AND n.node <> ex.node UNION SELECT av.variant, av.sample, gone, g.src FROM av JOIN g ON g.sample = av.sample AND g.dst = av.node AND g.src <> gone),
    pd AS (SELECT lv.variant, lv.sample, lv.node, p.node AS post FROM lv JOIN lv p ON p.variant = lv.variant AND p.sample = lv.sample AND p.node <> lv.node WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.variant = lv.variant AND av.sample = lv.sample AND av.gone = p.node AND av.node = lv.node)),
    np AS (SELECT variant, sample, node, count(*) AS k FROM pd GROUP BY ALL)"""
ORACLES = {
    "post_dominators": f"WITH RECURSIVE {_SHORT(3)}, {_POST} SELECT pd.sample, pd.variant, pd.node, pd.post FROM pd JOIN np a USING (variant, sample, node) LEFT JOIN np b ON b.variant = pd.variant AND b.sample = pd.sample AND b.node = pd.post WHERE coalesce(b.k, 0) = a.k - 1",
    "irreducible_cycles": f"""WITH RECURSIVE {_SHORT(4)}, {_PATH}, c AS (SELECT x.sample, x.a AS node, min(x.b) AS part FROM w x JOIN w y ON x.sample = y.sample AND x.a = y.b AND x.b = y.a GROUP BY 1, 2),
             doors AS (SELECT g.sample, b.part, b.node FROM g JOIN c a ON a.sample = g.sample AND a.node = g.src JOIN c b ON b.sample = g.sample AND b.node = g.dst AND b.part <> a.part UNION SELECT en.sample, part, node FROM en JOIN c ON c.sample = en.sample AND c.node = en.entry)
        SELECT sample, part AS first_node, count(*) AS size FROM c GROUP BY 1, 2 HAVING count(*) > 1 AND (SELECT count(DISTINCT d.node) FROM doors d WHERE d.sample = c.sample AND d.part = c.part) > 1""",
    # a stack and a queue, worked off one node at a time
    "bfs_dfs_positions": f"""WITH RECURSIVE {_SHORT(3)}, su AS (SELECT sample, src, list(dst ORDER BY dst) AS up, list(dst ORDER BY dst DESC) AS down FROM g GROUP BY 1, 2),
             ds AS (SELECT sample, [entry] AS todo, []::BIGINT[] AS seen FROM en UNION ALL
                    SELECT ds.sample, todo[:-2] || CASE WHEN list_contains(seen, todo[-1]) THEN [] ELSE coalesce(down, []) END, CASE WHEN list_contains(seen, todo[-1]) THEN seen ELSE list_append(seen, todo[-1]) END FROM ds LEFT JOIN su ON su.sample = ds.sample AND su.src = todo[-1] WHERE len(todo) > 0),
             bs AS (SELECT sample, [entry] AS seen, 1 AS k FROM en UNION ALL SELECT bs.sample, seen || list_filter(coalesce(up, []), lambda x: NOT list_contains(seen, x)), k + 1 FROM bs LEFT JOIN su ON su.sample = bs.sample AND su.src = seen[k] WHERE k <= len(seen)),
             dl AS (SELECT sample, arg_max(seen, len(seen)) AS seen FROM ds GROUP BY 1), bl AS (SELECT sample, arg_max(seen, len(seen)) AS seen FROM bs GROUP BY 1),
             r AS (SELECT n.sample, n.node, count(*) OVER (PARTITION BY n.sample) AS n, dl.seen AS d, bl.seen AS b, len(dl.seen) + sum(CASE WHEN list_contains(dl.seen, n.node) THEN 0 ELSE 1 END) OVER (PARTITION BY n.sample ORDER BY n.node) - 1 AS later FROM nodes n JOIN dl USING (sample) JOIN bl USING (sample))
        SELECT sample, node, (CASE WHEN list_contains(d, node) THEN list_position(d, node) - 1 ELSE later END) / greatest(n - 1, 1) AS dfs, (CASE WHEN list_contains(b, node) THEN list_position(b, node) - 1 ELSE later END) / greatest(n - 1, 1) AS bfs FROM r""",
    "binary_regions": f"""WITH RECURSIVE {_G}, {_REACH}, {_AVOID}, {_DOM}, {_BACK}, b2 AS (SELECT * FROM be WHERE src <> dst),
             body AS (SELECT sample, src, dst, src AS node FROM b2 UNION SELECT sample, src, dst, dst FROM b2 UNION SELECT b.sample, b.src, b.dst, g.src FROM body b JOIN g ON g.sample = b.sample AND g.dst = b.node WHERE b.node <> b.dst),
             rest AS (SELECT sample, node FROM nodes EXCEPT SELECT sample, node FROM body), u AS (SELECT g.sample, src AS a, dst AS b FROM g JOIN rest x ON x.sample = g.sample AND x.node = src JOIN rest y ON y.sample = g.sample AND y.node = dst WHERE src % 2 = dst % 2),
             u2 AS (SELECT sample, a, b FROM u UNION SELECT sample, b, a FROM u), c AS (SELECT sample, node, node AS other FROM rest UNION SELECT c.sample, c.node, u2.b FROM c JOIN u2 ON u2.sample = c.sample AND u2.a = c.other), p AS (SELECT sample, node, min(other) AS part FROM c GROUP BY 1, 2)
        SELECT sample, 4 AS role, dst AS header, string_agg(node, ',' ORDER BY node) AS nodes FROM body GROUP BY sample, src, dst UNION ALL
        SELECT sample, part % 2, CASE WHEN part % 2 = 1 THEN part END, string_agg(node, ',' ORDER BY node) FROM p GROUP BY sample, part""",
    # ifs at 1 and 4, then the switch at 2; each only if no earlier region holds it
    "structural_regions": f"""WITH RECURSIVE {_SHORT(3)}, {_REACH}, {_AVOID}, {_DOM}, {_BACK}, {_POST}, b2 AS (SELECT * FROM be WHERE src <> dst AND dst = 0),
             body AS (SELECT sample, src, dst, src AS node FROM b2 UNION SELECT sample, src, dst, dst FROM b2 UNION SELECT b.sample, b.src, b.dst, g.src FROM body b JOIN g ON g.sample = b.sample AND g.dst = b.node WHERE b.node <> b.dst),
             mg AS (SELECT pd.sample, pd.node AS h, pd.post AS merge FROM pd JOIN np a USING (variant, sample, node) LEFT JOIN np b ON b.variant = pd.variant AND b.sample = pd.sample AND b.node = pd.post WHERE pd.variant = 'first' AND coalesce(b.k, 0) = a.k - 1),
             hd AS (SELECT n.sample, n.node AS h, coalesce(merge, -1) AS merge FROM nodes n LEFT JOIN mg ON mg.sample = n.sample AND mg.h = n.node WHERE n.node IN (1, 2, 4) AND EXISTS (SELECT 1 FROM g WHERE g.sample = n.sample AND g.src = n.node) AND (n.node = 2 OR merge IS NOT NULL)),
             un AS (SELECT hd.sample, h, merge, g.dst AS node FROM hd JOIN g ON g.sample = hd.sample AND g.src = h AND g.dst <> merge UNION SELECT un.sample, h, merge, g.dst FROM un JOIN g ON g.sample = un.sample AND g.src = un.node AND g.dst <> merge),
             rg AS (SELECT sample, h, h AS node FROM hd UNION SELECT sample, h, node FROM un), t0 AS (SELECT DISTINCT sample, node FROM body),
             r1 AS (SELECT * FROM rg WHERE h = 1 AND (sample, 1) NOT IN (SELECT (sample, node) FROM t0)), t1 AS (SELECT * FROM t0 UNION SELECT sample, node FROM r1),
             r4 AS (SELECT * FROM rg WHERE h = 4 AND (sample, 4) NOT IN (SELECT (sample, node) FROM t1)), t4 AS (SELECT * FROM t1 UNION SELECT sample, node FROM r4),
             r2 AS (SELECT * FROM rg WHERE h = 2 AND (sample, 2) NOT IN (SELECT (sample, node) FROM t4)), t2 AS (SELECT * FROM t4 UNION SELECT sample, node FROM r2),
             rest AS (SELECT sample, node, [4, 1, 7, 0, 1][node + 1] AS role FROM nodes WHERE (sample, node) NOT IN (SELECT (sample, node) FROM t2)),
             u AS (SELECT x.sample, x.node AS a, y.node AS b FROM rest x JOIN rest y ON x.sample = y.sample AND x.role = y.role JOIN g ON g.sample = x.sample AND (g.src = x.node AND g.dst = y.node OR g.src = y.node AND g.dst = x.node)),
             c AS (SELECT sample, role, node, least(node, coalesce((SELECT min(b) FROM u WHERE u.sample = rest.sample AND u.a = rest.node), node)) AS part FROM rest)
        SELECT sample, CAST(4 AS BIGINT) AS role, CAST(0 AS BIGINT) AS header, string_agg(node, ',' ORDER BY node) AS nodes FROM body GROUP BY sample, src UNION ALL
        SELECT sample, CASE WHEN h = 2 THEN 7 ELSE 1 END, h, string_agg(node, ',' ORDER BY node) FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r2) GROUP BY sample, h UNION ALL
        SELECT sample, role, CASE WHEN role > 0 THEN part END, string_agg(node, ',' ORDER BY node) FROM c GROUP BY sample, role, part""",
    "pattern_labels": f"""WITH RECURSIVE {_G}, {_REACH}, {_AVOID}, {_DOM}, h AS (SELECT DISTINCT g.sample, g.dst AS b FROM g JOIN dom ON dom.sample = g.sample AND dom.dom = g.dst AND dom.node = g.src),
             bl AS (SELECT sample, src AS b FROM g UNION SELECT sample, dst FROM g)
        SELECT sample, b, CAST(CASE WHEN (sample, b) IN (SELECT (sample, b) FROM h) THEN 4 WHEN EXISTS (SELECT 1 FROM g JOIN h ON h.sample = g.sample AND h.b = g.dst WHERE g.sample = bl.sample AND g.src = bl.b AND g.dst <= g.src) THEN 5 ELSE 0 END AS INTEGER) AS role FROM bl""",
    "degrees": f"WITH {_G}, x AS (SELECT sample, src AS node, 1 AS o, 0 AS i FROM g UNION ALL SELECT sample, dst, 0, 1 FROM g) SELECT sample, node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY 1, 2",
    "reachability": f"WITH RECURSIVE {_G}, {_REACH} SELECT sample, node FROM r",
    "dominators": f"WITH RECURSIVE {_G}, {_REACH}, {_AVOID}, {_DOM} SELECT sample, dom, node FROM dom",
    "immediate_dominators": f"WITH RECURSIVE {_G}, {_REACH}, {_AVOID}, {_DOM}, k AS (SELECT sample, node, count(*) AS k FROM dom GROUP BY 1, 2) SELECT dom.sample, dom.node, dom.dom AS idom FROM dom JOIN k a ON a.sample = dom.sample AND a.node = dom.node JOIN k b ON b.sample = dom.sample AND b.node = dom.dom WHERE b.k = a.k - 1",
    "loop_headers": f"WITH RECURSIVE {_G}, {_REACH}, {_AVOID}, {_DOM} SELECT DISTINCT g.sample, g.dst AS header FROM g JOIN dom ON dom.sample = g.sample AND dom.dom = g.dst AND dom.node = g.src",
    "loop_bodies": f"""
        WITH RECURSIVE {_G}, {_REACH}, {_AVOID}, {_DOM}, be AS (SELECT g.sample, g.src, g.dst FROM g JOIN dom ON dom.sample = g.sample AND dom.dom = g.dst AND dom.node = g.src),
             body AS (SELECT sample, dst AS header, dst AS node FROM be UNION SELECT sample, dst, src FROM be UNION SELECT b.sample, b.header, g.src FROM body b JOIN g ON g.sample = b.sample AND g.dst = b.node AND b.node <> b.header JOIN r ON r.sample = g.sample AND r.node = g.src)
        SELECT DISTINCT sample, header, node FROM body""",
    "scc": f"WITH RECURSIVE {_G}, {_PATH} SELECT x.sample, x.a AS node, min(x.b) AS component FROM w x JOIN w y ON x.sample = y.sample AND x.a = y.b AND x.b = y.a GROUP BY 1, 2",
    "label_components": f"WITH RECURSIVE {_G}, u AS (SELECT sample, src AS a, dst AS b FROM g WHERE src % 2 = dst % 2 UNION SELECT sample, dst, src FROM g WHERE src % 2 = dst % 2), c AS (SELECT sample, node, node AS other FROM nodes UNION SELECT c.sample, c.node, u.b FROM c JOIN u ON u.sample = c.sample AND u.a = c.other) SELECT sample, node, min(other) AS region FROM c GROUP BY 1, 2",
    "shortest_paths": f"WITH RECURSIVE {_G}, p AS (SELECT sample, node AS src, node AS dst, 0 AS steps FROM nodes UNION SELECT p.sample, p.src, g.dst, steps + 1 FROM p JOIN g ON g.sample = p.sample AND g.src = p.dst WHERE steps < 5) SELECT sample, src, dst, CAST(min(steps) AS BIGINT) AS steps FROM p GROUP BY 1, 2, 3",
}

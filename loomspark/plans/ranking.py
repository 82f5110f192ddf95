"""Queries on ranking, tiers, text and sequence scores, retrieval and transport."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import scores as S
from loomspark.functions import text as T
from loomspark.operators import labels as L
from loomspark.operators import ranking as R
from loomspark.operators import retrieval as E
from loomspark.operators import transport as O
from loomspark.operators.settle import settled

from .tables import read


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("size"), F.round(F.col("p_retailprice") / 1000, 6).alias("quality"), (F.col("p_size") > 25).alias("valid"), "p_type")


def soft_targets(spark: SparkSession, d: str) -> DataFrame:
    return R.soft_targets(_parts(spark, d), ["p_brand"], "quality", "valid", 0.2).select("p_partkey", "prob")


def ranker_pool_select(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).withColumn("score", F.round(R.learned_score(F.col("quality"), F.col("size") / 10), 6))
    pools = [F.col("valid") & (F.col("size") <= 27) & (F.col("quality") > 1.5), F.col("valid") & (F.col("size") <= 27), F.col("valid"), F.lit(True)]
    return R.pooled_choice(p, ["p_brand", "p_type"], pools, "score", "p_partkey")


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return R.best(_parts(spark, d).select("p_brand", "p_partkey", "quality"), ["p_brand"], F.col("quality"), "p_partkey")


def capped_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.capped(_parts(spark, d).select("p_brand", "p_partkey", "size", "quality"), ["p_brand"], [F.desc("size"), F.desc("quality"), F.desc("p_partkey")], 7)


def hard_negative_cap(spark: SparkSession, d: str) -> DataFrame:
    return R.half_top_half_drawn(_parts(spark, d).select("p_brand", "p_partkey", "quality"), ["p_brand"], "p_partkey", [F.desc("quality"), F.col("p_partkey")], F.md5(F.col("p_partkey").cast("string")), 10).select("p_brand", "p_partkey")


def oracle_hits(spark: SparkSession, d: str) -> DataFrame:
    return R.hits_at(_parts(spark, d), ["p_brand"], [F.desc("quality"), F.col("p_partkey")], F.col("size") > 40)


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.preference_pairs(_parts(spark, d), "p_brand", "p_partkey", "quality", F.col("valid"), "7", 32)


def _slots(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    types = F.array(*map(F.lit, ["COND", "BLOCK", "GOTO", "EARLY_EXIT", "LOOP"]))
    tier = R.confidence_tier(F.lit(False), F.col("o_orderstatus") == "P", F.col("o_totalprice") > 1000, F.col("o_totalprice") > 2000, F.col("o_totalprice") > 5000, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.col("o_totalprice") > 300000)
    return o.select("o_orderkey", F.get(types, (F.substring("o_orderpriority", 1, 1).cast("int") - 1)).alias("slot_type"), tier.alias("tier"))


def tier_ladder_bucket(spark: SparkSession, d: str) -> DataFrame:
    s = _slots(spark, d)
    return s.select("o_orderkey", "tier", F.round(R.tier_weight(F.col("tier")), 6).alias("weight"), R.curriculum_bucket(F.col("slot_type"), R.tier_rank(F.col("tier"))).alias("bucket"))


def candidate_families(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("_", F.lower(F.regexp_replace("p_type", " ", "_")), F.when(F.col("p_size") > 40, "interval").when(F.col("p_size") > 30, "switch_chain").when(F.col("p_size") > 20, "mixed").otherwise("x"))
    return read(spark, d, "part").groupBy(R.family(name).alias("family")).agg(F.count("*").alias("n"))


def validator_scores(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("g"), F.count_if(F.col("l_linestatus") == "O").alias("b"))
    zero = F.lit(0)
    score = R.validator_score(F.col("n") > 2, F.col("n"), F.col("q"), F.lit(0.5), F.col("b"), {"goto": F.col("g"), "break": F.col("b"), "continue": zero, "early_exit": zero, "cleanup_exit": zero}, zero, zero, F.col("g"), (F.col("n") > 6).cast("int"))
    return line.select("l_orderkey", F.round(score, 6).alias("score"))


def binary_scores(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    features = {"structured_bb_ratio": F.col("p_size") / 50, "goto_count": F.col("p_size") % 5, "fallback_bb_ratio": F.col("p_size") / 100, "switch_semantic_ratio": F.lit(0.5), "edge_goto_ratio": F.lit(0.25)}
    family = F.when(F.col("p_size") > 40, "switch_fanin").when(F.col("p_size") > 30, "switch_chain").otherwise("other")
    return p.select("p_partkey", F.round(R.binary_score(features, F.col("p_retailprice") > 1200, F.col("p_size"), F.lit(3), F.lit(0.9), family), 6).alias("score"))


def compact_pool(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand's parts every eleventh has a core name; families and signatures are taken from type and container."""
    names = F.array(*map(F.lit, R.CORE))
    core = F.get(names, (F.col("p_partkey") / 11 % len(R.CORE)).cast("int"))
    family = F.when(F.col("p_size") > 40, "mixed_if_policy").otherwise(F.substring_index("p_type", " ", 1))
    p = read(spark, d, "part").select(F.col("p_brand").alias("sample"), "p_partkey", F.when(F.col("p_partkey") % 11 == 0, core).otherwise(F.col("p_name")).alias("name"), family.alias("family"), (F.col("p_size") % 9).cast("string").alias("signature"), F.col("p_retailprice").alias("quality"))
    return R.compact_pool(p, "sample", "p_partkey", ["quality"], 20, 6, 4, 2).select("sample", "p_partkey", "original_id", "name")


def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(T.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("value") > 50).alias("high"))
    pick = lambda high: F.transform(F.array_sort(F.collect_list(F.when(F.col("high") == high, F.struct("event_id", "event_type")))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(pick(True).alias("a"), pick(False).alias("b"))


def lcs_f1(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("user_id", F.round(S.lcs_f1("a", "b"), 6).alias("f1"))


def sequence_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("user_id", S.sequence_distance("a", "b").cast("long").alias("distance"))


def js_divergence(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    types = ["click", "error", "purchase", "signup", "view"]
    share = lambda cond: F.array(*[F.count_if(cond & (F.col("event_type") == t)) / F.greatest(F.lit(1), F.count_if(cond)) for t in types])
    per = e.groupBy("user_id").agg(share(F.col("value") > 50).alias("p"), share(F.col("value") <= 50).alias("q"))
    return per.select("user_id", F.round(S.js_divergence(F.col("p"), F.col("q")), 6).alias("js"))


def token_ids_crc32(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "documents").select("doc_id", T.token_ids(F.col("text"), 32000).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ids"))


def value_buckets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(S.log2_bucket(F.floor("o_totalprice")).alias("bucket")).agg(F.count("*").alias("n"))


def text_rules(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    return p.select(
        "page_id",
        T.brace_balance(F.col("html"), "<", ">").cast("long").alias("balance"),
        F.length(T.strip_comments(F.col("url"))).cast("long").alias("stripped"),
        T.slot_id(F.concat(F.lit("slot_"), F.col("page_id").cast("string"))).alias("slot"),
        T.contains_any(F.col("html"), ["script", "table"]).alias("has_needle"),
    )


def rewards(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    x = p.select("p_partkey", S.structural_reward(F.lit(0.25), F.levenshtein("p_name", "p_type"), F.greatest(F.length("p_name"), F.length("p_type")), F.col("p_size"), F.lit(25)).alias("s"))
    return x.select("p_partkey", F.round(S.combined_reward(F.lit(1.0), F.col("s"), F.lit(0.5)), 6).alias("reward"))


def hard_negatives_topk(spark: SparkSession, d: str) -> DataFrame:
    return E.hard_negatives(read(spark, d, "embeddings"), "vec_id", "label", "embedding", 5)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), "label")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(nxt, "vec_id").select(F.floor(F.col("vec_id") / 64).cast("long").alias("batch"), "vec_id", "a", "b", "label")


def infonce(spark: SparkSession, d: str) -> DataFrame:
    return E.batch_losses(_pairs(spark, d), "batch", "vec_id", "a", "b", "label").select("batch", "n", F.round("infonce", 4).alias("infonce"))


def graph_contrast_mask(spark: SparkSession, d: str) -> DataFrame:
    return E.batch_losses(_pairs(spark, d), "batch", "vec_id", "a", "b", "label").select("batch", "n", F.round("masked", 4).alias("masked"))


def _with_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the five nearest rows of other labels, for both sides; a pair's b is the row after its a."""
    found = settled(hard_negatives_topk(spark, d))  # both sides read it, and the search is the work
    near = E.negative_vectors(found, read(spark, d, "embeddings"), "vec_id", "embedding")
    after = near.select((F.col("vec_id") - 1).alias("vec_id"), F.col("negatives").alias("near_b"))
    return _pairs(spark, d).join(near.withColumnRenamed("negatives", "near_a"), "vec_id", "left").join(after, "vec_id", "left")


def graph_contrast_multi_positive(spark: SparkSession, d: str) -> DataFrame:
    out = E.graph_contrast(_with_negatives(spark, d), "batch", "vec_id", "a", "b", "label", "multi_positive", 0.07, "near_a", "near_b")
    return out.select("batch", "n", F.round("loss", 4).alias("loss"))


def graph_contrast_hard(spark: SparkSession, d: str) -> DataFrame:
    out = E.graph_contrast(_with_negatives(spark, d), "batch", "vec_id", "a", "b", "label", "mask_neg", 0.07, "near_a", "near_b")
    return out.select("batch", "n", F.round("loss", 4).alias("loss"))


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Sides by a hash of the row; a set is one function's, some dozens of rows."""
    side = (F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1), 16, 10).cast("int") % 2).alias("side")
    return read(spark, d, "embeddings").select(F.concat_ws("/", "label", F.floor(F.col("vec_id") / 640).cast("string")).alias("label"), side, "vec_id", "embedding")


def sinkhorn_plan(spark: SparkSession, d: str) -> DataFrame:
    def kernel(x, y):
        p = O.sinkhorn(O.cosine_cost(x, y))
        return [(i, j, float(p[i, j])) for i in range(len(x)) for j in range(len(y))]

    return O.per_pair_of_sets(_sides(spark, d), "label", "side", "vec_id", "embedding", kernel)


def structured_plan(spark: SparkSession, d: str) -> DataFrame:
    def kernel(x, y, a, b, penalty):
        p = O.structured_sinkhorn(O.cosine_cost(x, y), np.eye(len(x), k=1), np.eye(len(y), k=1), a=a, b=b, penalty=penalty)
        return [(i, j, float(p[i, j])) for i in range(len(x)) for j in range(len(y))]

    # side 0 are blocks with shares of two roles, side 1 statements with a type; chains in the order of the keys
    sides = _sides(spark, d).withColumn("mass", 1 + F.col("vec_id") % 3)
    blocks, v = sides.where("side = 0").select("label", F.col("vec_id").alias("b")), F.col("b")
    shares = blocks.select("label", "b", (v % 10).cast("int").alias("role"), F.lit(0.75).alias("p")).union(blocks.select("label", "b", ((v + 3) % 10).cast("int"), F.lit(0.25)))
    statements = sides.where("side = 1").select("label", F.col("vec_id").alias("s"), (F.col("vec_id") % 16).cast("int").alias("ast"))
    penalty = L.type_penalty(shares, statements, spark, ["label"]).select("label", F.col("b").alias("a"), F.col("s").alias("b"), "penalty")
    return O.per_pair_of_sets(sides, "label", "side", "vec_id", "embedding", kernel, "mass", penalty)


def hungarian(spark: SparkSession, d: str) -> DataFrame:
    def kernel(x, y):
        c = O.cosine_cost(x, y)
        return [(i, j, float(c[i, j])) for i, j in O.hungarian(c)]

    return O.per_pair_of_sets(_sides(spark, d), "label", "side", "vec_id", "embedding", kernel)


def greedy_pairs(spark: SparkSession, d: str) -> DataFrame:
    def kernel(x, y):
        s = 1 - O.cosine_cost(x, y)
        return [(i, j, float(s[i, j])) for i, j in O.greedy(s, 0.0)]

    return O.per_pair_of_sets(_sides(spark, d), "label", "side", "vec_id", "embedding", kernel)


QUERIES = {
    f.__name__: f
    for f in (
        soft_targets, ranker_pool_select, best_candidate, capped_candidates, hard_negative_cap, oracle_hits, preference_pairs, tier_ladder_bucket, candidate_families, validator_scores, binary_scores, compact_pool, edit_similarity,
        lcs_f1, sequence_edit_distance, js_divergence, token_ids_crc32, value_buckets, text_rules, rewards, hard_negatives_topk, infonce, graph_contrast_mask, graph_contrast_multi_positive, graph_contrast_hard, sinkhorn_plan, structured_plan, hungarian, greedy_pairs,
    )
}

_P = "p AS (SELECT p_partkey, p_brand, p_size AS size, round(p_retailprice / 1000, 6) AS quality, p_size > 25 AS valid, p_type FROM part)"
_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_LOSS = f"""WITH {_V}, q AS (SELECT a.vec_id // 64 AS batch, a.vec_id AS id, a.e AS a, b.e AS b, a.label AS u FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
    s AS (SELECT x.batch, x.id AS i, y.id AS j, list_inner_product(x.a, y.b) / 0.07 AS s FROM q x JOIN q y USING (batch) WHERE {{mask}}),
    r AS (SELECT batch, i, max(s) + ln(sum(exp(s - m))) - max(s) FILTER (i = j) AS l FROM (SELECT *, max(s) OVER (PARTITION BY batch, i) AS m FROM s) GROUP BY batch, i),
    c AS (SELECT batch, j, max(s) + ln(sum(exp(s - m))) - max(s) FILTER (i = j) AS l FROM (SELECT *, max(s) OVER (PARTITION BY batch, j) AS m FROM s) GROUP BY batch, j)
    SELECT batch, count(*) AS n, round((avg(r.l) + (SELECT avg(l) FROM c WHERE c.batch = r.batch)) / 2, 4) AS {{name}} FROM r GROUP BY batch"""
_SEQ = "q AS (SELECT user_id, coalesce(list(event_type ORDER BY event_id) FILTER (value > 50), []) AS a, coalesce(list(event_type ORDER BY event_id) FILTER (value <= 50), []) AS b FROM events GROUP BY 1)"
ORACLES = {
    "soft_targets": f"""WITH {_P}, k AS (SELECT *, valid OR NOT bool_or(valid) OVER w AS pool FROM p WINDOW w AS (PARTITION BY p_brand)), e AS (SELECT *, CASE WHEN pool THEN exp(least(60, quality / 0.2 - max(CASE WHEN pool THEN quality / 0.2 END) OVER w)) END AS e FROM k WINDOW w AS (PARTITION BY p_brand))
        SELECT p_partkey, round(coalesce(e / sum(e) OVER (PARTITION BY p_brand), 0), 8) AS prob FROM e""",
    "ranker_pool_select": f"""WITH {_P}, k AS (SELECT *, round(quality + 0.08 * size / 10, 6) AS score, CASE WHEN valid AND size <= 27 AND quality > 1.5 THEN 0 WHEN valid AND size <= 27 THEN 1 WHEN valid THEN 2 ELSE 3 END AS pool FROM p)
        SELECT p_brand, p_type, p_partkey, score, pool FROM k QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY pool, score DESC, p_partkey) = 1""",
    "best_candidate": f"WITH {_P} SELECT p_brand, p_partkey, quality FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY quality DESC, p_partkey) = 1",
    "capped_candidates": f"WITH {_P}, k AS (SELECT p_brand, p_partkey, size, quality, row_number() OVER (PARTITION BY p_brand ORDER BY size DESC, quality DESC, p_partkey DESC) AS place FROM p) SELECT * FROM k WHERE place <= 7",
    "hard_negative_cap": f"""WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY quality DESC, p_partkey) <= 5 AS top FROM p),
        x AS (SELECT *, row_number() OVER (PARTITION BY p_brand, top ORDER BY md5(CAST(p_partkey AS VARCHAR))) AS r FROM k) SELECT p_brand, p_partkey FROM x WHERE top OR r <= 5""",
    "oracle_hits": f"WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY quality DESC, p_partkey) AS r FROM p) SELECT p_brand, bool_or(size > 40 AND r <= 1) AS top1, bool_or(size > 40 AND r <= 3) AS top3, bool_or(size > 40 AND r <= 5) AS top5 FROM k GROUP BY 1",
    "preference_pairs": f"""WITH {_P}, t AS (SELECT p_brand, arg_max(p_partkey, (quality, -p_partkey)) AS better, max(quality) AS top FROM p WHERE valid GROUP BY 1),
             n AS (SELECT p_brand, better, p_partkey AS worse, top - quality AS gap, row_number() OVER (PARTITION BY p_brand ORDER BY quality DESC, p_partkey) AS r FROM p JOIN t USING (p_brand) WHERE p_partkey <> better AND top - quality > 1e-6),
             x AS (SELECT *, row_number() OVER (PARTITION BY p_brand, r <= 16 ORDER BY md5('7:' || worse), worse) AS h FROM n)
        SELECT p_brand, better, worse, round(least(greatest(gap, 0.1), 2), 6) AS weight FROM x WHERE r <= 16 OR h <= 16""",
    "tier_ladder_bucket": """
        WITH s AS (SELECT o_orderkey, ['COND', 'BLOCK', 'GOTO', 'EARLY_EXIT', 'LOOP'][CAST(o_orderpriority[1] AS INTEGER)] AS t, CASE WHEN o_orderstatus = 'P' OR o_totalprice <= 5000 THEN 0 WHEN o_totalprice > 300000 THEN 3 WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 2 ELSE 1 END AS r FROM orders)
        SELECT o_orderkey, 'C' || r AS tier, [0.0, 0.0, 0.2, 0.5][r + 1] AS weight, CASE WHEN r >= 3 THEN 'strong' WHEN r >= 2 THEN 'weak' ELSE 'prior' END || '_' ||
               CASE WHEN t = 'COND' THEN 'condition' WHEN t = 'BLOCK' THEN 'block' WHEN t IN ('GOTO', 'EARLY_EXIT') THEN 'control_transfer' ELSE 'other' END AS bucket FROM s""",
    "candidate_families": "SELECT CASE WHEN p_size > 40 THEN 'sese_interval' WHEN p_size > 30 THEN 'switch_chain' WHEN p_size > 20 THEN 'mixed_if_policy' ELSE 'other' END AS family, count(*) AS n FROM part GROUP BY 1",
    "validator_scores": """
        WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, count(*) FILTER (l_returnflag = 'R') AS g, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)
        SELECT l_orderkey, round(CASE WHEN n > 2 THEN 1000 ELSE 0 END + 20.0 * n + 0.5 * q + 4 - 2 * b - 0.2 * g - 0.08 * b - 3 * g - CASE WHEN n > 6 THEN 100 ELSE 0 END, 6) AS score FROM l""",
    "binary_scores": """SELECT p_partkey, round(CASE WHEN p_retailprice > 1200 THEN 1000 ELSE 0 END + 28 * p_size / 50 + 1.5 - 24 * p_size / 100 - 1.25 * (p_size % 5) - 0.35 * 3 / greatest(1, p_size) - 12 * 0.1
        + CASE WHEN p_size > 40 THEN 1.25 + 2.5 - 0.1875 - p_size / 100 WHEN p_size > 30 THEN -(0.75 + 0.375 + p_size / 100) ELSE 0 END, 6) AS score FROM part""",
    # the best pair of what is left, again and again
    "greedy_pairs": """WITH RECURSIVE v AS (SELECT label || '/' || vec_id // 640 AS label, vec_id, CAST(embedding AS DOUBLE[]) AS e, ('0x' || md5(CAST(vec_id AS VARCHAR))[1])::INT % 2 AS side FROM embeddings),
             s AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS s FROM v x JOIN v y ON x.label = y.label AND x.side = 0 AND y.side = 1),
             g AS (SELECT label, []::BIGINT[] AS ua, []::BIGINT[] AS ub, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS s FROM (SELECT DISTINCT label FROM s) UNION ALL
                   SELECT label, list_append(ua, m.a), list_append(ub, m.b), m.a, m.b, m.s FROM (SELECT g.label, ua, ub, arg_max(struct_pack(a := s.a, b := s.b, s := s.s), (s.s, -s.a, -s.b)) AS m FROM g JOIN s ON s.label = g.label AND NOT list_contains(ua, s.a) AND NOT list_contains(ub, s.b) AND s.s >= 0 GROUP BY 1, 2, 3))
        SELECT label, a, b, s AS value FROM g WHERE a IS NOT NULL""",
    # the table of prefixes one row at a time, a row from the one before
    "lcs_f1": f"""WITH RECURSIVE {_SEQ}, t AS (SELECT user_id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS r FROM q UNION ALL
             SELECT user_id, a, b, i + 1, [0] || list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], r[k] + CASE WHEN b[k] = a[i + 1] THEN 1 ELSE 0 END)))) FROM t WHERE i < len(a))
        SELECT user_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(2 * r[-1] / (len(a) + len(b)), 6) END AS f1 FROM t WHERE i = len(a)""",
    "sequence_edit_distance": f"""WITH RECURSIVE {_SEQ}, t AS (SELECT user_id, a, b, 0 AS i, range(len(b) + 1) AS r FROM q UNION ALL
             SELECT user_id, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: least(i + 1 + j, coalesce(list_min(list_transform(range(1, j + 1), lambda k: least(r[k + 1] + 1, r[k] + CASE WHEN b[k] = a[i + 1] THEN 0 ELSE 1 END) + j - k)), i + 1 + j))) FROM t WHERE i < len(a))
        SELECT user_id, CAST(r[-1] AS BIGINT) AS distance FROM t WHERE i = len(a)""",
    "edit_similarity": "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type), 1), 6) AS similarity FROM part",
    "js_divergence": """
        WITH t AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS name), u AS (SELECT user_id, count(*) FILTER (value > 50) AS a, count(*) FILTER (value <= 50) AS b FROM events GROUP BY 1),
             s AS (SELECT u.user_id, name, greatest(count(event_id) FILTER (value > 50) / greatest(1, max(a)), 1e-8) AS p, greatest(count(event_id) FILTER (value <= 50) / greatest(1, max(b)), 1e-8) AS q FROM u CROSS JOIN t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = name GROUP BY 1, 2)
        SELECT user_id, round(sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))), 6) AS js FROM s GROUP BY 1""",
    "value_buckets": "SELECT CAST(CASE WHEN floor(o_totalprice) = 0 THEN 0 WHEN abs(floor(o_totalprice)) < 2 THEN 1 ELSE least(floor(log2(abs(floor(o_totalprice)))) + 1, 63) END AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "text_rules": """
        SELECT page_id, CAST(length(replace(html, '>', '')) - length(replace(html, '<', '')) AS BIGINT) AS balance, CAST(length(regexp_replace(url, '//[^\n]*$', ' ')) AS BIGINT) AS stripped,
               'slot_' || CASE WHEN length(CAST(page_id AS VARCHAR)) < 3 THEN lpad(CAST(page_id AS VARCHAR), 3, '0') ELSE CAST(page_id AS VARCHAR) END AS slot, contains(lower(html), 'script') OR contains(lower(html), 'table') AS has_needle FROM pages""",
    "rewards": """
        SELECT p_partkey, round(0.2 + 0.5 * (0.4 * 0.75 + 0.4 * (1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type), 1)) + 0.2 * (1 - abs(p_size - 25) / greatest(p_size, 25, 1))) + 0.15, 6) AS reward FROM part""",
    "hard_negatives_topk": f"""WITH {_V}, s AS (SELECT a.vec_id, b.vec_id AS other, round(list_inner_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.label <> b.label)
        SELECT vec_id, row_number() OVER w AS rank, other, score FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5""",
    "infonce": _LOSS.format(mask="true", name="infonce"),
    "graph_contrast_mask": _LOSS.format(mask="x.u <> y.u OR x.id = y.id", name="masked"),
}

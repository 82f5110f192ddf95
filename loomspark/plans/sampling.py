"""Queries on splits, samples and report aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import sampling as S
from loomspark.operators import stats as A

from .tables import read

SEED = "42"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_discount") * 10).alias("w"), F.col("l_quantity").alias("q"))


def split_811_a(spark: SparkSession, d: str) -> DataFrame:
    return S.split_parts(_docs(spark, d), ["lang"], SEED, "doc_id", "a").select("doc_id", "lang", "part")


def split_811_b(spark: SparkSession, d: str) -> DataFrame:
    return S.split_parts(_docs(spark, d), ["lang"], SEED, "doc_id", "b").select("doc_id", "lang", "part")


def group_fraction_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.group_fraction(_docs(spark, d), ["source"], SEED, "doc_id", 0.25).select("doc_id", "source")


def project_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.quota(_docs(spark, d), ["source"], SEED, "doc_id", 0.5).select("doc_id", "source")


def quota_of_intersection(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return S.quota_of(docs.where("lang = 'en'"), docs, ["source"], SEED, "doc_id", 0.3).select("doc_id", "source")


def worst_samples(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_discount"), 6).alias("conf"), F.count("*").alias("n"))
    return S.worst(per, "conf", 0.03, F.col("n") >= 3, "l_orderkey")


def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.reservoir(_docs(spark, d), SEED, "doc_id", 50).select("doc_id")


def pre_pooled_sample(spark: SparkSession, d: str) -> DataFrame:
    pool = S.pre_pool(_docs(spark, d), "doc_id", "9", "doc_id", 50)
    return S.reservoir(pool, SEED, "doc_id", 20).select("doc_id")


def spread_picks(spark: SparkSession, d: str) -> DataFrame:
    return S.spread(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 40)


def topk_complex(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("blocks"), F.count("*").alias("edges"))
    return S.largest(per.withColumn("score", 1000 * F.col("blocks") + F.col("edges")), [F.desc("score"), F.col("l_orderkey")], 25)


def tail_n(spark: SparkSession, d: str) -> DataFrame:
    return S.largest(read(spark, d, "events").select("event_id", "user_id", "event_type"), [F.desc("event_id")], 100)


def conf_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.tenths_histogram(_weights(spark, d), "w")


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return A.upper_median(read(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")


def calibration(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(F.col("l_discount") * 10), 6).alias("mean_w"), F.avg("l_quantity").alias("in_order"), F.avg("l_tax").alias("one_hot"), F.count("*").alias("coverage"))
    return A.calibration(per, "mean_w", ["in_order", "one_hot", "coverage"])


def totals_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("long").alias("finished"), F.lit(1).cast("long").alias("n_orders"))
    return A.totals(rows, "o_orderpriority", ["finished", "n_orders"])


def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
    return A.baseline_delta(o, "o_orderstatus", "o_orderpriority", "1-URGENT", "mean_price")


def most_common_other(spark: SparkSession, d: str) -> DataFrame:
    return A.most_common(read(spark, d, "part"), "p_brand", 5)


def macro_average(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem")
    metrics = {"mean_quantity": F.avg("l_quantity"), "returned_share": F.avg((F.col("l_returnflag") == "R").cast("double"))}
    return A.macro_average(rows, ["l_orderkey"], ["l_linestatus"], metrics)


def standardise(spark: SparkSession, d: str) -> DataFrame:
    return A.standardised(read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["size", "price"]).select("p_partkey", "z_size", "z_price")


def type_shares(spark: SparkSession, d: str) -> DataFrame:
    return A.shares(read(spark, d, "events"), [], "event_type")


def cumulative_levels(spark: SparkSession, d: str) -> DataFrame:
    return A.cumulative(read(spark, d, "orders"), "o_orderpriority")


def band_verdicts(spark: SparkSession, d: str) -> DataFrame:
    share = F.round(F.col("p_size") / 50, 6)
    return read(spark, d, "part").select("p_partkey", share.alias("share"), *[A.verdict(m, share).alias(m) for m in A.BANDS])


QUERIES = {
    "split_811_a": split_811_a, "split_811_b": split_811_b, "group_fraction_sample": group_fraction_sample, "project_quota_sample": project_quota_sample,
    "quota_of_intersection": quota_of_intersection, "worst_samples": worst_samples, "reservoir_sample": reservoir_sample, "pre_pooled_sample": pre_pooled_sample, "spread_picks": spread_picks, "topk_complex": topk_complex, "tail_n": tail_n, "conf_histogram": conf_histogram,
    "upper_median": upper_median, "calibration": calibration, "totals_rollup": totals_rollup, "baseline_delta": baseline_delta, "most_common_other": most_common_other,
    "macro_average": macro_average, "standardise": standardise, "type_shares": type_shares, "cumulative_levels": cumulative_levels, "band_verdicts": band_verdicts,
}

_RANK = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM documents)"
ORACLES = {
    "split_811_a": _RANK.format(by="lang") + " SELECT doc_id, lang, CASE WHEN k <= n * 8 // 10 THEN 'train' WHEN k <= n * 8 // 10 + (n - n * 8 // 10) // 2 THEN 'val' ELSE 'test' END AS part FROM r",
    "split_811_b": _RANK.format(by="lang") + " SELECT doc_id, lang, CASE WHEN k <= n * 8 // 10 THEN 'train' WHEN k <= n * 8 // 10 + n // 10 THEN 'val' ELSE 'test' END AS part FROM r",
    "group_fraction_sample": _RANK.format(by="source") + " SELECT doc_id, source FROM r WHERE k <= greatest(1, floor(n * 0.25))",
    "project_quota_sample": _RANK.format(by="source") + " SELECT doc_id, source FROM r WHERE k <= round_even(n * 0.5, 0)",
    "quota_of_intersection": "WITH q AS (SELECT source, round_even(count(*) * 0.3, 0) AS q FROM documents GROUP BY 1), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents WHERE lang = 'en') SELECT doc_id, source FROM r JOIN q USING (source) WHERE k <= q",
    "worst_samples": "SELECT l_orderkey, round(avg(l_discount), 6) AS conf, count(*) AS n FROM lineitem GROUP BY 1 HAVING round(avg(l_discount), 6) < 0.03 AND count(*) >= 3 ORDER BY conf, l_orderkey LIMIT 5",
    "reservoir_sample": "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
    "pre_pooled_sample": "SELECT doc_id FROM documents WHERE CAST(('0x' || substr(md5('9:' || doc_id), 1, 8)) AS BIGINT) / 4294967296 < 50 / greatest(doc_id, 1) ORDER BY md5('42:' || doc_id), doc_id LIMIT 20",
    "spread_picks": "WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT o_orderkey, o_totalprice FROM r WHERE p IN (SELECT ((SELECT count(*) FROM orders) - 1) * i // 39 FROM range(40) t(i))",
    "topk_complex": "SELECT l_orderkey, count(DISTINCT l_suppkey) AS blocks, count(*) AS edges, 1000 * count(DISTINCT l_suppkey) + count(*) AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, l_orderkey LIMIT 25",
    "tail_n": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100",
    "conf_histogram": "SELECT CAST(CASE WHEN w < 0.1 THEN 0 WHEN w < 0.2 THEN 1 WHEN w < 0.3 THEN 2 WHEN w < 0.4 THEN 3 WHEN w < 0.5 THEN 4 WHEN w < 0.6 THEN 5 WHEN w < 0.7 THEN 6 WHEN w < 0.8 THEN 7 WHEN w < 0.9 THEN 8 ELSE 9 END AS INTEGER) AS bin, count(*) AS n FROM (SELECT CAST(l_discount * 10 AS DOUBLE) AS w FROM lineitem) WHERE w BETWEEN 0 AND 1 GROUP BY 1",
    "upper_median": "WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS p, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, l_quantity AS upper_median, n FROM r WHERE p = n // 2",
    "calibration": "WITH s AS (SELECT l_orderkey, round(avg(l_discount * 10), 6) AS w, avg(l_quantity) AS a, avg(l_tax) AS b, count(*) AS c FROM lineitem GROUP BY 1) SELECT CASE WHEN w >= 0.7 THEN 'high' ELSE 'middling' END AS band, count(*) AS n, round(avg(a), 6) AS in_order, round(avg(b), 6) AS one_hot, round(avg(c), 6) AS coverage FROM s WHERE w >= 0.3 GROUP BY 1",
    "totals_rollup": "SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(*) AS n_orders, round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / nullif(count(*), 0), 6) AS percent FROM orders GROUP BY ROLLUP (o_orderpriority)",
    "baseline_delta": "WITH m AS (SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY ALL) SELECT m.*, round(m.mean_price - b.mean_price, 6) AS delta FROM m LEFT JOIN m b ON b.o_orderstatus = m.o_orderstatus AND b.o_orderpriority = '1-URGENT'",
    "most_common_other": "WITH c AS (SELECT p_brand AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1) SELECT CASE WHEN k <= 5 THEN name ELSE '__other__' END AS name, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1",
    "macro_average": "WITH s AS (SELECT l_linestatus, l_orderkey, avg(l_quantity) AS a, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS b FROM lineitem GROUP BY ALL) SELECT l_linestatus, count(*) AS n_samples, round(avg(a), 6) AS mean_quantity, round(avg(b), 6) AS returned_share FROM s GROUP BY 1",
    "standardise": "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / coalesce(nullif(stddev_pop(p_size) OVER (), 0), 1), 6) AS z_size, round((p_retailprice - avg(p_retailprice) OVER ()) / coalesce(nullif(stddev_pop(p_retailprice) OVER (), 0), 1), 6) AS z_price FROM part",
    "type_shares": "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1",
    "cumulative_levels": "SELECT o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY o_orderpriority) AS BIGINT) AS upto FROM orders GROUP BY 1",
    "band_verdicts": "WITH s AS (SELECT p_partkey, round(p_size / 50, 6) AS share FROM part) SELECT p_partkey, share, CASE WHEN share BETWEEN 0.9 AND 0.95 THEN 'ok' WHEN share >= 0.85 THEN 'near' ELSE 'miss' END AS coverage, CASE WHEN share BETWEEN 0.75 AND 0.85 THEN 'ok' WHEN share >= 0.6 THEN 'near' ELSE 'miss' END AS high_confidence, CASE WHEN share BETWEEN 0.85 AND 0.9 THEN 'ok' WHEN share >= 0.75 THEN 'near' ELSE 'miss' END AS agreement, CASE WHEN share >= 0.9 THEN 'ok' WHEN share >= 0.85 THEN 'near' ELSE 'miss' END AS \"order\" FROM s",
}

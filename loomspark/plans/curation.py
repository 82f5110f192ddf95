"""Queries on identity, duplicates, levels and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import filters, keys

from .tables import read

#: Event types stand for the five optimisation levels, in this order.
LEVELS = ["click", "error", "purchase", "signup", "view"]


def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("_md5", F.md5("text"))
    return keys.keep_one(docs.select("doc_id", "lang", "source", "_md5"), [F.col("_md5")], F.col("doc_id")).select("doc_id", "lang", "source")


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("_md5", F.md5("text"))
    return keys.keep_one(docs.select("doc_id", "lang", "source", "_md5"), [F.col("_md5")], F.col("doc_id"), "first").select("doc_id", "lang", "source")


def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return keys.dedup_summary(read(spark, d, "documents"), F.md5("text"))


def key_multiplicity_hist(spark: SparkSession, d: str) -> DataFrame:
    return keys.multiplicity_histogram(read(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber"))


def exact_dup_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return keys.multiplicity_histogram(read(spark, d, "documents"), F.sha2("text", 256))


def top_key_diffs(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("text_key", F.md5("text"))
    return keys.top_key_diffs(docs.select("text_key", "doc_id", "lang", "source", "n_chars"), "text_key", "doc_id", ["lang", "source", "n_chars"], 10)


def all_levels_intersection(spark: SparkSession, d: str) -> DataFrame:
    return keys.keys_on_all_levels(read(spark, d, "events"), "user_id", "event_type", len(LEVELS))


def level_diff_full_outer(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return keys.level_diff(per.where("event_type = 'click'"), per.where("event_type = 'view'"), "user_id", "n")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("level", (F.array_position(F.array(*map(F.lit, LEVELS)), F.col("event_type")) - 1).cast("int"))


def prefix_unions(spark: SparkSession, d: str) -> DataFrame:
    found = keys.prefix_unions(_ranked(spark, d).where("level >= 0"), "level", [f"upto_{x}" for x in LEVELS])
    return found.groupBy("stage").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"))


def length_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    rules = [("chars", size(F.col("text")), 6000), ("lines", F.size(F.split("text", "\n")), 12), ("lang", size(F.col("lang")), 2)]
    return filters.length_reasons(read(spark, d, "documents"), rules).groupBy("reason").agg(F.count("*").alias("n"))


def corrupt_as_reason(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.try_parse_json("props")
    events = read(spark, d, "events").withColumn("k", F.try_variant_get(parsed, "$.k", "long"))
    reason = F.when(parsed.isNull(), "unparsable").when(F.col("k").isNull(), "missing_k").otherwise("kept")
    return events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))


def path_project_id(spark: SparkSession, d: str) -> DataFrame:
    url = T.rewrite_prefixes(F.col("url"), [("http://", "/net/"), ("https://", "/net/"), ("/net/www.", "/net/")])
    return read(spark, d, "pages").select("page_id", url.alias("path"), T.project_after(url, "NET").alias("project"))


def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("text_key", F.md5("text")).join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return keys.leakage(docs.where("quality IS NOT NULL"), docs.where("quality IS NULL"), "text_key").select("doc_id", "source")


def unique_only_index(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return keys.unique_only(docs, "n_chars")


def identity_policies(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(
        F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.concat(F.lit(" "), "source", F.lit("\\a.c"))).alias("source_file"),
        F.concat(F.lit("bin/"), "lang").alias("binary"),
        F.when(F.col("source") == "src3", F.lit(" ")).otherwise(F.concat("lang", F.lit(" "))).alias("func_name"),
    )
    frames = [keys.dedup_summary(docs, keys.identity_key(p)).withColumn("policy", F.lit(p)) for p in keys.POLICIES]
    return keys.all_rows(frames).select("policy", "total", "unique_keys", "extra", "missing")


def concat_projects(spark: SparkSession, d: str) -> DataFrame:
    """Files named by split, project and level, concatenated: a name pattern, an allow list and an exclusion list."""
    docs = read(spark, d, "documents")
    name = F.concat(F.lit("set_"), F.when(F.col("doc_id") % 2 == 0, "AB").otherwise("CD"), F.lit("_"), "source", F.lit("_"), F.when(F.col("lang") == "en", "o0").when(F.col("lang") == "de", "o9").otherwise("os"), F.lit(".jsonl"))
    halves = [docs.where(f"doc_id % 2 = {k}").select("doc_id", name.alias("name")) for k in (0, 1)]
    found = keys.of_projects(keys.all_rows(halves), "name", r"^set_(AB|CD)_(.+)_((?:o[0-3])|os)\.jsonl$", {"split": 1, "project": 2, "level": 3}, [f"src{k}" for k in range(9)], ["src0", "src1"])
    return found.groupBy("split", "project", "level").agg(F.count("*").alias("n"))


QUERIES = {
    "dedup_keep_last": dedup_keep_last, "dedup_keep_first": dedup_keep_first, "dedup_summary": dedup_summary, "key_multiplicity_hist": key_multiplicity_hist,
    "exact_dup_redundancy": exact_dup_redundancy, "top_key_diffs": top_key_diffs, "all_levels_intersection": all_levels_intersection, "level_diff_full_outer": level_diff_full_outer,
    "prefix_unions": prefix_unions, "length_filter_reasons": length_filter_reasons, "corrupt_as_reason": corrupt_as_reason, "path_project_id": path_project_id,
    "leakage_audit": leakage_audit, "unique_only_index": unique_only_index, "identity_policies": identity_policies, "concat_projects": concat_projects,
}

_HIST = "SELECT CASE WHEN c >= 10 THEN '10+' ELSE CAST(c AS VARCHAR) END AS bucket, count(*) AS n_keys, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS redundant FROM k GROUP BY 1"
ORACLES = {
    "dedup_keep_last": "SELECT max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source FROM documents GROUP BY text",
    "dedup_keep_first": "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
    "dedup_summary": "SELECT count(*) AS total, count(DISTINCT text) AS unique_keys, count(text) - count(DISTINCT text) AS extra, count(*) - count(text) AS missing FROM documents",
    "key_multiplicity_hist": f"WITH k AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) {_HIST}",
    "exact_dup_redundancy": f"WITH k AS (SELECT count(*) AS c FROM documents GROUP BY text) {_HIST}",
    "top_key_diffs": """
        WITH t AS (SELECT md5(text) AS text_key, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, text_key LIMIT 10),
             r AS (SELECT t.text_key, copies, d.*, row_number() OVER (PARTITION BY t.text_key ORDER BY doc_id) AS rn FROM t JOIN documents d ON md5(d.text) = t.text_key)
        SELECT a.text_key, a.copies, a.doc_id AS first_row, b.doc_id AS second_row, concat_ws(',', CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END,
               CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END, CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END) AS differing
        FROM r a JOIN r b ON a.text_key = b.text_key AND a.rn = 1 AND b.rn = 2""",
    "all_levels_intersection": "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5",
    "level_diff_full_outer": """
        WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT * FROM p WHERE event_type = 'click'), b AS (SELECT * FROM p WHERE event_type = 'view')
        SELECT CASE WHEN b.n IS NULL THEN 'only_a' WHEN a.n IS NULL THEN 'only_b' WHEN a.n = b.n THEN 'same' ELSE 'different' END AS state, count(*) AS n FROM a FULL JOIN b USING (user_id) GROUP BY 1""",
    "prefix_unions": """
        WITH l AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type, unnest(range(5)) AS rank)
        SELECT 'upto_' || s.event_type AS stage, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events JOIN l USING (event_type) JOIN l s ON l.rank <= s.rank GROUP BY 1""",
    "length_filter_reasons": """
        SELECT CASE WHEN length(text) > 6000 THEN 'chars' WHEN len(string_split(text, chr(10))) > 12 THEN 'lines' WHEN length(lang) > 2 THEN 'lang' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    "corrupt_as_reason": """
        WITH e AS (SELECT props, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)
        SELECT CASE WHEN NOT coalesce(json_valid(props), false) THEN 'unparsable' WHEN k IS NULL THEN 'missing_k' ELSE 'kept' END AS reason, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k FROM e GROUP BY 1""",
    "path_project_id": r"""
        WITH p AS (SELECT page_id, regexp_replace(regexp_replace(replace(url, '\', '/'), '^https?://', '/net/'), '^/net/www\.', '/net/') AS path FROM pages)
        SELECT page_id, path, CASE WHEN path LIKE '/net/%' THEN nullif(split_part(path, '/', 3), '') END AS project FROM p""",
    "leakage_audit": """
        WITH d AS (SELECT md5(text) AS k, doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id))
        SELECT doc_id, source FROM d WHERE quality IS NULL AND k IN (SELECT k FROM d WHERE quality IS NOT NULL)""",
    "unique_only_index": "SELECT doc_id, n_chars FROM documents QUALIFY count(*) OVER (PARTITION BY n_chars) = 1",
    "identity_policies": r"""
        WITH r AS (SELECT coalesce(CASE WHEN lang <> 'de' THEN ' ' || source || '\a.c' END, '') AS s, 'bin/' || lang AS b, CASE WHEN source = 'src3' THEN ' ' ELSE lang || ' ' END AS f FROM documents),
             p AS (SELECT 'dedup' AS policy, CASE WHEN s <> '' THEN replace(trim(s), '\', '/') ELSE b END AS a, trim(f) AS f FROM r UNION ALL
                   SELECT 'raw', CASE WHEN s <> '' THEN s ELSE b END, f FROM r UNION ALL SELECT 'trimmed', CASE WHEN s <> '' THEN trim(s) ELSE b END, trim(f) FROM r UNION ALL
                   SELECT 'function_source', s, f FROM r UNION ALL SELECT 'uid', CASE WHEN s <> '' THEN s ELSE b END, f FROM r),
             k AS (SELECT policy, CASE WHEN policy IN ('dedup', 'trimmed') AND (a = '' OR f = '') THEN NULL ELSE a || chr(1) || f END AS k FROM p)
        SELECT policy, count(*) AS total, count(DISTINCT k) AS unique_keys, count(k) - count(DISTINCT k) AS extra, count(*) - count(k) AS missing FROM k GROUP BY policy""",
    "concat_projects": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'AB' ELSE 'CD' END AS split, source AS project, CASE WHEN lang = 'en' THEN 'o0' ELSE 'os' END AS level, count(*) AS n FROM documents WHERE coalesce(lang, '') <> 'de' AND source IN ('src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8') GROUP BY ALL",
}

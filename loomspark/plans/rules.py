"""Queries on predicates, small projections, JSON Lines round trips and other operators of a few lines."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import scores as N
from loomspark.functions import text as T
from loomspark.operators import evidence as V
from loomspark.operators import filters as P
from loomspark.operators import graph as G
from loomspark.operators import joins as J
from loomspark.operators import labels as L
from loomspark.operators import losses as M
from loomspark.operators import ranking as R
from loomspark.operators import sampling as S
from loomspark.operators import transport as O
from loomspark.operators.settle import shared_folder
from loomspark.sources import jsonl
from loomspark.streaming import curriculum

from .tables import read


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/loomspark-{name}-{uuid.uuid4().hex}"


def without_tier(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("lang") == "en", "line_fallback").when(F.col("lang") == "de", "stmt")
    return P.without_tier(read(spark, d, "documents").select("doc_id", tier.alias("tier")), "tier")


def inside_range(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.where(P.inside(F.col("p_partkey"), F.col("p_size"), F.lit(100), F.lit(1000))).select("p_partkey")


def c_family(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, ["a.c", "b.h", "x/c.hpp", "d.cpp", "e.cc", ".c", "dir/.h", "f.C", "g.c.txt", ""]))
    names = read(spark, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.get(ends, (F.col("doc_id") % 10).cast("int"))).alias("path"))
    return names.where(P.c_family(F.col("path")))


def line_range_fits(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.where(P.fits_lines(F.col("p_size") - 3, F.col("p_size"), F.col("p_partkey") % 50)).select("p_partkey")


def enough_evidence(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg(F.when(F.col("l_discount") > 0.01, F.col("l_discount") * 10)).alias("conf"))
    return per.where(P.enough_evidence(F.col("n"), F.col("conf"), 3, 0.5)).select("l_orderkey")


def parsed_by_tree(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose statement types are not all `other`, or which have edges; without statements they are not parsed."""
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") > 10, F.when(F.col("l_tax") > 0.03, 15).otherwise(0))).alias("ast"), F.count_if(F.col("l_returnflag") == "R").alias("edges"))
    return per.select("l_orderkey", ((F.size("ast") > 0) & ~(P.all_equal("ast", 15) & (F.col("edges") == 0))).alias("parsed"))


def strict_validity(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 1000).alias("a"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("b"))
    return o.where(P.strict_validity(["a", "b"])).select("o_orderkey")


def training_references(spark: SparkSession, d: str) -> DataFrame:
    ref = F.struct(F.concat(F.lit("C"), (F.col("l_suppkey") % 5).cast("string")).alias("confidence_level"), (F.col("l_discount") - 0.02).alias("weight"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("part"))
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(ref), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise((a["part"] - b["part"]).cast("int"))).alias("refs"))
    kept = o.select("l_orderkey", P.training_references("refs", R.tier_rank, 2).alias("r")).where("r IS NOT NULL")
    return kept.select("l_orderkey", F.size("r").cast("long").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda s, x: s + x["normalized_weight"] * x["place"]), 6).alias("mean_place"))


def within_cap(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("l_linenumber"))).alias("ids"))
    return ids.where(P.within_cap("ids", 3)).select("l_orderkey")


def primary_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents' sources against a primary file by path or by relative path; every fifth row has no primary file."""
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("path"), F.col("lang").alias("rel"))
    none = F.col("doc_id") % 5 == 0
    return docs.where(P.of_primary_file(F.col("path"), F.col("rel"), F.when(none, "").otherwise(F.lit("src3")), F.when(~none, F.lit("de")))).select("doc_id")


def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    lab = F.when(F.col("l_returnflag") == "A", -100).otherwise((F.col("l_suppkey") % 2).cast("int"))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", (F.col("l_partkey") % 2).cast("int").alias("p"), lab.alias("l")))).alias("x"))
    rows = rows.select("l_orderkey", F.transform("x", lambda v: v["p"]).alias("p"), F.transform("x", lambda v: v["l"]).alias("l"))
    return rows.select("l_orderkey", F.round(P.token_accuracy("p", "l"), 6).alias("accuracy"))


def flattened_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.array("l_partkey", F.lit(None).cast("bigint")), F.lit(None).cast("array<bigint>"), F.array("l_suppkey"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(P.flattened_pairs(pairs), ",").alias("flat"))


def source_line_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line_no"), "text")
    places = read(spark, d, "documents").select(F.col("doc_id").alias("file"), (F.col("doc_id") % 4).cast("int").alias("line_no"))
    return J.source_text(places, lines, "?").select("file", "line_no", F.md5(F.col("text").cast("binary")).alias("digest"))


def probed_addresses(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id")
    blocks = e.where("event_id % 10 = 0").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 40).alias("end"))
    return V.probed(blocks, e.withColumnRenamed("event_id", "addr"), ["user_id"]).select("user_id", "start", "addr")


def first_root(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("source", "doc_id")
    pick = lambda lang: read(spark, d, "documents").where(F.col("lang") == lang).groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return jsonl.first_found({0: pick("it"), 1: pick("fr"), 2: docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"))}, "source").select("source", "doc_id", "root_rank")


def preferred_catalogue(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    pick = lambda lang: docs.where(F.col("lang") == lang).groupBy("source").agg(F.max("doc_id").alias("doc_id"))
    return jsonl.preferred(docs.select("source").distinct(), pick("fr"), pick("es"), "source", "doc_id")


def only_keys(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("arch"), "c_name")
    return jsonl.provenance(jsonl.only_keys(c, ["c_custkey", "arch"], {"arch": F.lit("x86_64"), "infer_only": F.lit(True)}), origin="customer")


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines, every seventh broken and some blank, are written and read back leniently."""
    docs = read(spark, d, "documents").select("doc_id", "lang")
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{broken "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.to_json(F.struct("doc_id", "lang")))
    path = _folder(spark, "lines")
    jsonl.write_raw(docs.select(line.alias("raw")), path)
    back = jsonl.lenient(spark, path, "doc_id bigint, lang string")
    return back.groupBy(F.col(jsonl.CORRUPT).isNotNull().alias("corrupt"), "lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def jsonl_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Rows at given lines of one written file."""
    path = _folder(spark, "numbered")
    jsonl.write_sorted_keys(read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("a")).orderBy("p_partkey").coalesce(1), path)
    rows = jsonl.at_lines(jsonl.numbered(spark, path), [0, 3, 17, 10_000_000])
    return rows.select("line", "raw")


def jsonl_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """All rows, one folder per known level and one for the rest, with a manifest of what was written."""
    path = _folder(spark, "levels")
    manifest = jsonl.write_by(read(spark, d, "documents").select("doc_id", "lang"), path, "lang", ["en", "de"], combined=True)
    kind = "doc_id bigint, lang string"
    ids = spark.read.schema(f"{kind}, part string").json(f"{path}/parts").groupBy("part").agg(F.sum("doc_id").alias("ids"))
    return manifest.join(ids, "part").select("part", "n_rows", "ids").unionByName(spark.read.schema(kind).json(f"{path}/combined").agg(F.lit("combined").alias("part"), F.count("*").alias("n_rows"), F.sum("doc_id").alias("ids")))


def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", F.struct(F.col("p_size").alias("z"), F.array(F.struct(F.col("p_size").alias("b"), F.lit(1).alias("a"))).alias("list")).alias("nested"))
    return rows.select("p_partkey", jsonl.canonical_json(rows).alias("json"))


def shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    manifest = jsonl.write_shards(read(spark, d, "part").select("p_partkey", "p_size"), _folder(spark, "shards"), 300)
    return manifest.agg((F.max("n_rows") <= 300).alias("bounded"), F.sum("n_rows").alias("n_rows"), (F.count("hash") == F.count("*")).alias("hashed"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """A report as a Markdown table and as an indented array."""
    r = read(spark, d, "region").select("r_regionkey", "r_name")
    return spark.createDataFrame([(jsonl.markdown_table(r.orderBy("r_regionkey")), jsonl.pretty_array(r, "r_regionkey"))], "markdown string, array string")


def file_line_counts(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "sizes")
    jsonl.write_report(read(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1), path)
    return jsonl.file_sizes(spark, path).select("n_lines", (F.col("bytes") > 100).alias("large"))


def opt_levels(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["busybox_o2", "x-O0", "foo1", "-Os", "a_O3.jsonl", "gcc -O1 -g", "o0-o2", "", "to1"]))
    p = read(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 9).cast("int")).alias("a"), F.get(names, (F.col("p_partkey") % 7).cast("int")).alias("b"))
    return p.select("p_partkey", T.opt_level(F.col("a"), F.col("b")).alias("level"))


def delimiter_balance(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together of marks, escapes and literals; each piece's part of the balance is known."""
    pieces = ["f(x[1])", "{ ", "'('", '"}\\""', "\\(", "))", "[", "a = 1;"]
    k = F.col("p_partkey")
    text = F.concat(*[F.get(F.array(*map(F.lit, pieces)), ((k / m).cast("long") % len(pieces)).cast("int")) for m in (1, 8, 64)])
    return read(spark, d, "part").select("p_partkey", T.delimiter_balance(text).alias("x")).select("p_partkey", "x.*")


def filtered_stream(spark: SparkSession, d: str) -> DataFrame:
    """Text lines through a stream that drops long ones, run until all that is there has passed."""
    source, out = _folder(spark, "stream-in"), _folder(spark, "stream-out")
    jsonl.write_raw(read(spark, d, "documents").select(F.concat(F.col("doc_id"), F.lit(" "), F.regexp_replace("text", r"\s+", " ")).alias("raw")), source)
    stream = curriculum.filtered_lines(spark, source, 300).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    stream.awaitTermination()
    return spark.read.schema("value string").parquet(out).select(F.substring_index("value", " ", 1).cast("long").alias("doc_id"), F.length("value").cast("long").alias("n"))


def slot_types(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, [*T.SLOT_TYPES, "cond", " Fill_Goto ", "other", ""]))
    return read(spark, d, "part").select("p_partkey", T.slot_type(F.get(names, (F.col("p_partkey") % (len(T.SLOT_TYPES) + 4)).cast("int"))).alias("type"))


def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", float("nan")).when(F.col("o_orderstatus") == "F", float("inf")).otherwise(F.col("o_totalprice")).alias("v"), "o_custkey")
    return o.select("o_orderkey", N.safe_float(F.col("v"), -1.0).alias("safe"), F.round(N.ratio(N.safe_float(F.col("v")), F.col("o_custkey") % 3), 4).alias("ratio"), F.round(N.count_similarity(F.col("o_custkey") % 7, F.col("o_orderkey") % 5), 6).alias("similarity"))


def padded_operands(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("int")))).alias("v"))
    return rows.select("l_orderkey", F.array_join(V.padded("v", 3), ",").alias("operands"))


def summed_counters(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "orders").select(F.map_from_arrays(F.array(F.lit("all"), F.concat(F.lit("status_"), "o_orderstatus")), F.array(F.lit(1), (F.col("o_custkey") % 3).cast("int"))).alias("m"))
    return V.summed_maps(c, "m")


def instance_verdicts(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_returnflag") != "R").cast("double")).alias("score"))
    return per.groupBy(V.instance_verdict(F.col("score")).alias("verdict")).agg(F.count("*").alias("n"))


def document_quality(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    x = F.col("p_size") / 50
    return p.select("p_partkey", F.round(N.document_quality(x, 1 - x, F.lit(0.5), x / 2, F.col("p_size") > 5, F.col("p_size") % 7, F.col("p_size") % 5, F.col("p_size")), 6).alias("quality"))


def count_losses(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(M.count_error(F.col("l_linenumber"), F.col("l_suppkey") % 5), 6).alias("loss"))


def spread_rounded(spark: SparkSession, d: str) -> DataFrame:
    return S.spread_rounded(read(spark, d, "part").select("p_partkey"), "p_partkey", 23)


def compound_regions(spark: SparkSession, d: str) -> DataFrame:
    """Statements of an order with an edge to the next number; a part's brand parity makes compounds."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("n")).agg((F.min("l_suppkey") % 3).alias("c"))
    nodes = rows.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("x"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for sample, x in zip(pdf["sample"], pdf["x"], strict=True):
                own = {int(r["n"]): int(r["c"]) for r in x}
                edges = [(n, n + 1) for n in own if n + 1 in own]
                found = G.compound_regions(sorted(own), edges, {n: c if c else -1 for n, c in own.items()}, {n: n % 2 for n in own})
                out += [(sample, h, ",".join(map(str, ns))) for _, h, ns in found]
            yield pd.DataFrame(out, columns=["sample", "header", "nodes"])

    return nodes.mapInPandas(run, "sample bigint, header bigint, nodes string")


def region_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Regions of two sides of a function, types that differ by an even number go together."""
    side = (F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1), 16, 10).cast("int") % 2).alias("side")
    sets = read(spark, d, "embeddings").select(F.concat_ws("/", "label", F.floor(F.col("vec_id") / 640).cast("string")).alias("label"), side, "vec_id", "embedding")

    def kernel(x, y):
        mask = (np.arange(len(x))[:, None] + np.arange(len(y))[None, :]) % 2 == 0
        plan, pairs = O.region_pairs(x, y, mask)
        return [(i, j, round(float(plan[i, j]), 6)) for i, j in pairs]

    return O.per_pair_of_sets(sets, "label", "side", "vec_id", "embedding", kernel)


def external_scores(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return R.external_scores(p, lambda b: b["size"] * 2 + 1)


def label_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Headers chosen from old roles, source lines, edges and dispatching blocks, then repaired roles."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("b")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("k"))
    words = F.array(*map(F.lit, ["x = 1;", "switch (x) {", "case 1:", "for (;;) {", "if (x)", "break;"]))
    line = F.col("p") % 6
    blocks = rows.select("sample", "b", (F.col("k") % 10).cast("int").alias("role"), F.get(words, line.cast("int")).alias("text"), (F.col("p") % 11 == 0).alias("indirect"), (F.col("p") % 13 == 0).alias("structural"))
    lines = rows.select("sample", "b", line.alias("line"), F.get(words, line.cast("int")).alias("text"))
    edges = rows.select("sample", F.col("b").alias("src"), (F.col("b") + 1 - 2 * (F.col("k") % 2)).alias("dst"), F.when(F.col("k") % 2 == 1, 2).otherwise(1).alias("etype"))
    out = L.loop_evidence(L.switch_evidence(blocks, edges, lines), edges, lines)
    return out.select("sample", "b", "switch_header", "switch_case", "loop_header", "back_source")


QUERIES = {
    f.__name__: f
    for f in (
        without_tier, inside_range, c_family, line_range_fits, enough_evidence, parsed_by_tree, strict_validity, training_references, within_cap, primary_file_lines, token_accuracy, flattened_pairs, source_line_lookup, probed_addresses,
        first_root, preferred_catalogue, only_keys, jsonl_round_trip, jsonl_numbered, jsonl_fan_out, canonical_json, shard_manifest, reports, file_line_counts, opt_levels, delimiter_balance, filtered_stream, slot_types, safe_numbers, padded_operands, summed_counters, instance_verdicts, document_quality,
        count_losses, spread_rounded, compound_regions, region_alignment, external_scores, label_evidence,
    )
}

# names of slots with their types, in the order of the query's list, written out by hand
_ALIAS = """('FILL_COND', 'COND'), ('COND_SLOT', 'COND'), ('CONDITION', 'COND'), ('SWITCH_DISPATCH', 'COND'), ('FILL_STMT', 'STMT'), ('STATEMENT', 'STMT'), ('FILL_BLOCK', 'BLOCK'), ('BLOCK_SLOT', 'BLOCK'), ('UNSTRUCTURED_REGION', 'BLOCK'), ('FILL_CASE', 'CASE_LABEL'),
    ('CASE_SLOT', 'CASE_LABEL'), ('CASE', 'CASE_LABEL'), ('FILL_GOTO', 'EXIT'), ('GOTO_SLOT', 'EXIT'), ('GOTO', 'EXIT'), ('FILL_CLEANUP_EXIT', 'EXIT'), ('CLEANUP_EXIT_SLOT', 'EXIT'), ('CLEANUP_EXIT', 'EXIT'), ('FILL_BREAK', 'LOOP_EXIT'), ('BREAK_SLOT', 'LOOP_EXIT'),
    ('BREAK', 'LOOP_EXIT'), ('FILL_CONTINUE', 'LOOP_EXIT'), ('CONTINUE_SLOT', 'LOOP_EXIT'), ('CONTINUE', 'LOOP_EXIT'), ('LOOP_CONTINUE', 'LOOP_EXIT'), ('FILL_EARLY_EXIT', 'RETURN'), ('EARLY_EXIT_SLOT', 'RETURN'), ('EARLY_EXIT', 'RETURN')"""
_NAMES = """'FILL_COND', 'COND_SLOT', 'CONDITION', 'SWITCH_DISPATCH', 'FILL_STMT', 'STATEMENT', 'FILL_BLOCK', 'BLOCK_SLOT', 'UNSTRUCTURED_REGION', 'FILL_CASE', 'CASE_SLOT', 'CASE', 'FILL_GOTO', 'GOTO_SLOT', 'GOTO', 'FILL_CLEANUP_EXIT', 'CLEANUP_EXIT_SLOT', 'CLEANUP_EXIT',
    'FILL_BREAK', 'BREAK_SLOT', 'BREAK', 'FILL_CONTINUE', 'CONTINUE_SLOT', 'CONTINUE', 'LOOP_CONTINUE', 'FILL_EARLY_EXIT', 'EARLY_EXIT_SLOT', 'EARLY_EXIT', 'cond', ' Fill_Goto ', 'other', ''"""
_LEVELS = "['busybox_o2', 'x-O0', 'foo1', '-Os', 'a_O3.jsonl', 'gcc -O1 -g', 'o0-o2', '', 'to1']"
# the level that each of these has, read by hand
_FOUND = "['o2', 'o0', NULL, 'os', 'o3', 'o1', 'o0', NULL, NULL]"
ORACLES = {
    "without_tier": "SELECT doc_id, CASE WHEN lang = 'de' THEN 'stmt' END AS tier FROM documents WHERE lang IS NULL OR lang <> 'en'",
    "inside_range": "SELECT p_partkey FROM part WHERE p_partkey >= 100 AND p_partkey + p_size <= 1100",
    "c_family": "WITH n AS (SELECT doc_id, source || '/' || ['a.c', 'b.h', 'x/c.hpp', 'd.cpp', 'e.cc', '.c', 'dir/.h', 'f.C', 'g.c.txt', ''][doc_id % 10 + 1] AS path FROM documents) SELECT * FROM n WHERE doc_id % 10 < 4",
    "line_range_fits": "SELECT p_partkey FROM part WHERE p_size - 3 >= 1 AND p_size <= p_partkey % 50 + 20",
    "enough_evidence": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND coalesce(avg(l_discount * 10) FILTER (l_discount > 0.01), 0) >= 0.5",
    "parsed_by_tree": "SELECT l_orderkey, count(*) FILTER (l_quantity > 10) > 0 AND NOT (count(*) FILTER (l_quantity > 10 AND l_tax <= 0.03) = 0 AND count(*) FILTER (l_returnflag = 'R') = 0) AS parsed FROM lineitem GROUP BY 1",
    "strict_validity": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'",
    "training_references": "WITH r AS (SELECT l_orderkey, l_discount - 0.02 AS w, l_linenumber AS place FROM lineitem WHERE l_suppkey % 5 >= 2 AND l_discount - 0.02 > 0), n AS (SELECT *, round(w / sum(w) OVER (PARTITION BY l_orderkey), 8) AS v FROM r) SELECT l_orderkey, count(*) AS n, round(sum(v * place), 6) AS mean_place FROM n GROUP BY 1",
    "within_cap": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'A') BETWEEN 1 AND 3",
    "primary_file_lines": "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR source = 'src3' OR lang = 'de'",
    "token_accuracy": """WITH x AS (SELECT l_orderkey, l_partkey % 2 AS p, CASE WHEN l_returnflag = 'A' THEN -100 ELSE l_suppkey % 2 END AS l, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_partkey % 2, CASE WHEN l_returnflag = 'A' THEN -100 ELSE l_suppkey % 2 END) AS k FROM lineitem)
        SELECT l_orderkey, round(coalesce(count(*) FILTER (k > 1 AND l <> -100 AND p = l) / nullif(count(*) FILTER (k > 1 AND l <> -100), 0), 0), 6) AS accuracy FROM x GROUP BY 1""",
    "flattened_pairs": "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_partkey || ',' || l_suppkey AS flat FROM lineitem",
    "source_line_lookup": "SELECT doc_id AS file, CAST(doc_id % 4 AS INTEGER) AS line_no, md5(CASE WHEN text IS NULL OR doc_id % 4 = 0 THEN '?' ELSE coalesce(string_split(text, chr(10))[doc_id % 4], '?') END) AS digest FROM documents",
    "probed_addresses": 'SELECT b.user_id, b.event_id AS start, e.event_id AS addr FROM events b JOIN events e ON e.user_id = b.user_id AND e.event_id BETWEEN b.event_id AND b.event_id + 40 AND (e.event_id - b.event_id) % 4 = 0 WHERE b.event_id % 10 = 0',
    "first_root": "WITH r AS (SELECT source, doc_id, CASE lang WHEN 'it' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS k FROM documents), b AS (SELECT source, min(k) AS k, min(doc_id) AS least FROM r GROUP BY 1) SELECT b.source, CASE WHEN b.k = 2 THEN least ELSE (SELECT min(doc_id) FROM r WHERE r.source IS NOT DISTINCT FROM b.source AND r.k = b.k) END AS doc_id, CAST(b.k AS INTEGER) AS root_rank FROM b",
    "preferred_catalogue": "SELECT source, coalesce(max(doc_id) FILTER (lang = 'fr'), max(doc_id) FILTER (lang = 'es')) AS doc_id FROM documents GROUP BY 1",
    "only_keys": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'x86_64' END AS arch, true AS infer_only, 'customer' AS origin FROM customer",
    "jsonl_round_trip": "SELECT doc_id % 7 = 0 AS corrupt, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, count(*) AS n, CAST(sum(CASE WHEN doc_id % 7 <> 0 THEN doc_id END) AS BIGINT) AS ids FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 <> 0 GROUP BY 1, 2",
    "jsonl_numbered": "WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS line FROM part) SELECT line, '{\"a\":\"' || p_brand || '\",\"p_partkey\":' || p_partkey || '}' AS raw FROM p WHERE line IN (0, 3, 17)",
    "jsonl_fan_out": "SELECT CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'unknown' END AS part, count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1 UNION ALL SELECT 'combined', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents",
    "canonical_json": """SELECT p_partkey, '{"nested":{"list":[{"a":1,"b":' || p_size || '}],"z":' || p_size || '},"p_partkey":' || p_partkey || '}' AS json FROM part""",
    "shard_manifest": "SELECT true AS bounded, count(*) AS n_rows, true AS hashed FROM part",
    "reports": """SELECT '| r_regionkey | r_name |' || chr(10) || '| - | - |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS markdown,
        '[' || chr(10) || string_agg('  {' || chr(10) || '    "r_regionkey": ' || r_regionkey || ',' || chr(10) || '    "r_name": "' || r_name || '"' || chr(10) || '  }', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || ']' AS "array" FROM region""",
    "file_line_counts": "SELECT count(*) + 1 AS n_lines, true AS large FROM nation",
    "opt_levels": f"SELECT p_partkey, coalesce({_FOUND}[p_partkey % 9 + 1], {_FOUND}[p_partkey % 7 + 1], 'unknown') AS level FROM part",
    # by piece: parentheses, brackets and braces that it adds
    "delimiter_balance": """WITH k AS (SELECT p_partkey, unnest([p_partkey % 8, p_partkey // 8 % 8, p_partkey // 64 % 8]) AS i FROM part)
        SELECT p_partkey, CAST(sum([0, 0, 0, 0, 0, -2, 0, 0][i + 1]) AS INTEGER) AS paren, CAST(sum([0, 0, 0, 0, 0, 0, 1, 0][i + 1]) AS INTEGER) AS bracket, CAST(sum([0, 1, 0, 0, 0, 0, 0, 0][i + 1]) AS INTEGER) AS brace FROM k GROUP BY 1""",
    "filtered_stream": r"WITH l AS (SELECT doc_id, doc_id || ' ' || regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') AS value FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(value) AS n FROM l WHERE length(value) <= 300",
    "slot_types": f"WITH a(name, kind) AS (VALUES {_ALIAS}), n AS (SELECT p_partkey, upper(trim([{_NAMES}][p_partkey % 32 + 1])) AS name FROM part) SELECT p_partkey, coalesce(kind, n.name) AS type FROM n LEFT JOIN a USING (name)",
    "safe_numbers": "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'F') THEN -1 ELSE o_totalprice END AS safe, round(CASE WHEN o_orderstatus IN ('P', 'F') THEN 0 ELSE o_totalprice END / greatest(1, o_custkey % 3), 4) AS ratio, round(greatest(0, 1 - abs(o_custkey % 7 - o_orderkey % 5) / greatest(1, o_orderkey % 5)), 6) AS similarity FROM orders",
    "padded_operands": "SELECT l_orderkey, array_to_string((coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag <> 'R'), []) || [0, 0, 0])[1:3], ',') AS operands FROM lineitem GROUP BY 1",
    "summed_counters": "SELECT 'all' AS name, count(*) AS n FROM orders UNION ALL SELECT 'status_' || o_orderstatus, CAST(sum(o_custkey % 3) AS BIGINT) FROM orders GROUP BY 1",
    "instance_verdicts": "WITH s AS (SELECT avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) AS s FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN s >= 0.9 THEN 'MATCH' WHEN s >= 0.5 THEN 'PARTIAL' ELSE 'MISMATCH' END AS verdict, count(*) AS n FROM s GROUP BY 1",
    "document_quality": "SELECT p_partkey, round(0.42 * p_size / 50 + 0.22 * (1 - p_size / 50) + 0.07 + 0.06 * p_size / 50 + CASE WHEN p_size > 5 THEN 0.1 ELSE -1 END - least(0.25, 0.01 * (p_size % 7) + 0.008 * (p_size % 5) + 0.002 * p_size), 6) AS quality FROM part",
    "count_losses": "SELECT l_returnflag, round(avg(pow(l_linenumber - l_suppkey % 5, 2)), 6) AS loss FROM lineitem GROUP BY 1",
    "spread_rounded": "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part) SELECT p_partkey FROM r WHERE p IN (SELECT CAST(round_even(i * ((SELECT count(*) FROM part) - 1) / 22, 0) AS BIGINT) FROM range(23) t(i))",
    "compound_regions": """WITH s AS (SELECT l_orderkey AS sample, l_linenumber AS n, min(l_suppkey) % 3 AS c FROM lineitem GROUP BY 1, 2), l AS (SELECT *, CASE WHEN c > 0 THEN c ELSE -1 - n % 2 END AS l FROM s),
             b AS (SELECT *, CASE WHEN lag(n) OVER w = n - 1 AND lag(l) OVER w = l THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY sample ORDER BY n)), r AS (SELECT *, sum(new) OVER (PARTITION BY sample ORDER BY n) AS r FROM b)
        SELECT sample, CAST(min(n) AS BIGINT) AS header, string_agg(n, ',' ORDER BY n) AS nodes FROM r GROUP BY sample, r""",
    "external_scores": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_size AS DOUBLE) * 2 + 1 AS score FROM part",
    "label_evidence": """WITH r AS (SELECT l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS b, min(l_partkey) AS p, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2), x AS (SELECT *, p % 6 AS line, k % 10 = 7 AS old, p % 11 = 0 AS dispatch, p % 6 = 1 AS sw FROM r),
             c AS (SELECT sample, arg_min(b, (NOT dispatch, b)) AS b FROM x WHERE sw GROUP BY sample), h AS (SELECT * FROM c UNION SELECT sample, b FROM x WHERE dispatch AND sample NOT IN (SELECT sample FROM c)),
             o AS (SELECT sample, b, CASE WHEN b - lag(b) OVER (PARTITION BY sample ORDER BY b) > 3 THEN 1 ELSE 0 END AS new FROM x WHERE old), q AS (SELECT sample, b, sum(new) OVER (PARTITION BY sample ORDER BY b) AS q, (sample, b) IN (SELECT (sample, b) FROM h) AS is_head FROM o),
             f AS (SELECT sample, b, b = coalesce(min(b) FILTER (is_head) OVER w, min(b) OVER w) AS first FROM q WINDOW w AS (PARTITION BY sample, q)),
             e AS (SELECT sample, b AS src, b - 1 AS dst FROM x WHERE k % 2 = 1), lc AS (SELECT x.*, (sample, b) IN (SELECT (sample, dst) FROM e) AS target FROM x), cand AS (SELECT * FROM lc WHERE target OR p % 13 = 0),
             lh AS (SELECT sample, arg_min(b, (NOT target, b)) AS b FROM cand WHERE line = 3 GROUP BY sample UNION SELECT sample, b FROM cand WHERE line <> 3)
        SELECT x.sample, x.b, (x.sample, x.b) IN (SELECT (sample, b) FROM h) OR coalesce(f.first, false) AS switch_header, (line = 2 OR NOT coalesce(f.first, true)) AND NOT ((x.sample, x.b) IN (SELECT (sample, b) FROM h) OR coalesce(f.first, false)) AS switch_case,
               (x.sample, x.b) IN (SELECT (sample, b) FROM lh) AS loop_header, k % 2 = 1 AS back_source FROM x LEFT JOIN f USING (sample, b)""",
}

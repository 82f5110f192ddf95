import json
import os

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import keys, ranking, sampling, validate
from loomspark.sources import jsonl
from loomspark.streaming import curriculum

ROW = {
    "binary": "b_o0", "func_name": "f", "opt_level": "o0", "source_file": "/src/p/a.c", "bin_block_lengths": [2, 1], "bin_opcodes": [5, 6, 7], "bin_operand_types": [1, 2, 0, 1, 0, 0, 0, 0, 0],
    "bin_operand_values": [3, 1, 0, 2, 0, 0, 0, 0, 0], "bin_edge_index": [[0], [1]], "bin_edge_type": [1], "bin_struct_features": [[0.0] * 12, [1.0] * 12], "pattern_labels": [0, 0],
    "src_token_ids": [11, 12, 13], "src_stmt_lengths": [2, 1], "src_ast_types": [15, 8], "src_edge_index": [[0], [1]], "src_edge_type": [1],
    "alignment_matrix": [[1.0, 0.0], [0.0, 1.0]], "alignment_confidence": [[0.76, 0.0], [0.0, 0.76]],
}
BROKEN = [
    ({"bin_block_lengths": []}, "no blocks"), ({"bin_opcodes": [1]}, "opcodes do not add up"), ({"bin_operand_types": [1]}, "operand types are not 3 per instruction"),
    ({"bin_operand_values": [1]}, "operand values are not 3 per instruction"), ({"pattern_labels": [0]}, "labels do not match blocks"), ({"bin_struct_features": [[0.0] * 12]}, "features do not match blocks"),
    ({"bin_struct_features": [[0.0] * 12, [0.0]]}, "features are not 12 wide"), ({"bin_edge_index": [[0]]}, "bin_edge_index is not a pair"), ({"bin_edge_index": [[0], []]}, "bin_edge_index halves differ in length"),
    ({"src_token_ids": []}, "source side missing"), ({"src_ast_types": [1]}, "syntax types do not match statements"), ({"alignment_matrix": [[1.0, 0.0]]}, "alignment_matrix rows do not match blocks"),
    ({"alignment_matrix": [[1.0], [1.0]]}, "alignment_matrix is not as wide as the statements"), ({"alignment_confidence": [[1.0, 0.0]]}, "alignment_confidence rows do not match blocks"),
]


def lines(tmp_path, rows):
    (tmp_path / "in.jsonl").write_text("\n".join(rows))
    return str(tmp_path / "in.jsonl")


def test_shape_rules(spark, tmp_path):
    path = lines(tmp_path, [json.dumps(ROW), *[json.dumps(ROW | x) for x, _ in BROKEN]])
    rows = jsonl.parsed(jsonl.numbered(spark, path)).select("line", "rec.*")
    found = [r.error_alignment for r in validate.checked(rows).orderBy("line").collect()]
    assert found == [None, *[m for _, m in BROKEN]]
    good = rows.where("line = 0")
    assert [tuple(r) for r in validate.cells(good, "line").collect()] == [(0, 0, 0, 1.0, 0.76), (0, 1, 1, 1.0, 0.76)]
    assert [tuple(r) for r in validate.edges(good, "line").collect()] == [(0, 0, 0, 1, 1)]
    assert [tuple(r) for r in validate.blocks(good, "line").collect()] == [(0, 0, 0, 2, 0), (0, 1, 2, 1, 0)]


def test_dirty_lines(spark, tmp_path):
    a, b = json.dumps({"func_name": " f ", "source_file": "p\\a.c", "binary": "x"}), json.dumps({"func_name": "f", "source_file": "p/a.c", "binary": "y"})
    path = lines(tmp_path, [a, "", "{broken", b, json.dumps({"binary": "z"}), a])
    assert jsonl.lenient(spark, path).cache().where(F.col(jsonl.CORRUPT).isNotNull()).count() == 1
    with pytest.raises(Exception):  # noqa: B017
        jsonl.strict(spark, path).collect()
    rows = jsonl.numbered(spark, path)
    assert [r.raw for r in rows.orderBy("line").collect()] == [a, "{broken", b, json.dumps({"binary": "z"}), a]
    good = jsonl.parsed(rows).select("line", "raw", "rec.func_name", "rec.source_file", "rec.binary").where("func_name IS NOT NULL")
    last = keys.keep_one(good, [keys.identity_key("dedup")], F.col("line"))
    assert [(r.line, r.raw) for r in last.collect()] == [(4, a)]
    jsonl.write_raw(last, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [a]


def test_sinks(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "o0").otherwise("x").alias("opt"))
    assert jsonl.write_shards(df.repartition(2), str(tmp_path / "s"), 100).agg(F.sum("n_rows"), F.max("n_rows")).first()[:] == (1000, 100)
    jsonl.write_by(df, str(tmp_path / "b"), "opt", ["o0", "o1"])
    assert {r.part for r in spark.read.json(str(tmp_path / "b")).select("part").distinct().collect()} == {"o0", "unknown"}
    jsonl.write_sorted_keys(df.limit(1), str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).first().value.startswith('{"id"')


def test_ir_blocks(spark, tmp_path):
    (tmp_path / "a.ll").write_text('define i32 @f(i32 %0) {\n  %2 = add i32 %0, 1, !dbg !7\n  br label %loop, !dbg !8\nloop:\n  ret i32 %2, !dbg !8\n}\n!7 = !DILocation(line: 12, column: 1)\n!8 = !DILocation(line: 14, column: 1)\n')
    rows = jsonl.ir_blocks(spark, str(tmp_path / "a.ll")).orderBy("ord").collect()
    assert [(r.func, r.label, r.lines, r.first_line) for r in rows] == [("f", "entry", [12, 14], 12), ("f", "loop", [14], 14)]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.opt_level(F.lit("zlib_O2.jsonl")).alias("a"), T.opt_level(F.lit("gcc -Os x.c")).alias("b"), T.opt_level(F.lit("foo2")).alias("c"), T.slot_id(F.lit("slot_7")).alias("d"), T.slot_id(F.lit("slot_0012")).alias("e"),
        T.token_id(F.lit("int"), 32000).alias("f"), T.token_ids(F.lit("  "), 32000).alias("g"), T.strip_comments(F.lit("a /* b\n */ c // d\ne")).alias("h"), T.project_after(F.lit("C:\\Src\\zlib\\a.c"), "src", 1).alias("i"),
        T.is_control(F.lit(" if (x)")).alias("j"), T.is_control(F.lit("iffy")).alias("k"), T.brace_balance(F.lit("{{}")).alias("l"),
    ).first()
    assert tuple(row) == ("o2", "os", "unknown", "slot_007", "slot_012", 23375, [0], "a   c  \ne", "zlib", True, False, 1)


def test_split_sizes(spark):
    for n, a, b in ((9, (7, 1, 1), (7, 0, 2)), (10, (8, 1, 1), (8, 1, 1)), (19, (15, 2, 2), (15, 1, 3))):
        df = spark.range(n).withColumn("g", F.lit(1))
        for variant, sizes in (("a", a), ("b", b)):
            got = {r.part: r["count"] for r in sampling.split_parts(df, ["g"], "1", "id", variant).groupBy("part").count().collect()}
            assert tuple(got.get(p, 0) for p in ("train", "val", "test")) == sizes
    for n, k in ((5, 2), (7, 4)):
        assert sampling.quota(spark.range(n).withColumn("g", F.lit(1)), ["g"], "1", "id", 0.5).count() == k


def test_compaction_frees_other_caps(spark):
    rows = [("s", k, name, fam, sig) for k, (name, fam, sig) in enumerate([("core", "a", "x"), ("p", "a", "x"), ("q", "a", "y"), ("r", "b", "y"), ("t", "b", "z"), ("u", "b", "w")])]
    df = spark.createDataFrame(rows, "sample string, k int, name string, family string, signature string").withColumn("score", F.lit(1.0))
    out = ranking.compact_pool(df, "sample", "k", ["score"], 4, 2, 1, keep=("core",)).orderBy("k").collect()
    assert [(r.name, r.k, r.original_id) for r in out] == [("core", 0, 0), ("q", 1, 2), ("t", 2, 4), ("u", 3, 5)]


def test_pairwise_ranker_prefers():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([2.0, -1.0, 0.0])
    i, j = rng.integers(0, 200, (2, 400))
    up = y[i] > y[j]
    w = ranking.fit_pairwise(x[np.where(up, i, j)], x[np.where(up, j, i)], np.ones(400))
    assert np.corrcoef(x @ w, y)[0, 1] > 0.98


def test_stage_stream_equals_replay(spark, tmp_path):
    rows = [("a", k, float(v)) for k, v in enumerate([5, 4, 4, 4, 4, 3, 2, 2, 2, 2, 2])]
    df = spark.createDataFrame(rows, "run string, epoch int, loss double")
    batch = [(r.stage, r.event) for r in curriculum.replay(df, "run", "epoch", "loss").orderBy("epoch").collect()]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:4], rows[4:])):
        file = tmp_path / "in" / f"{k}.json"
        file.write_text("\n".join(json.dumps({"run": a, "epoch": b, "loss": c}) for a, b, c in part))
        os.utime(file, (1000 + k, 1000 + k))  # files arrive by their time
    source = spark.readStream.schema("run string, epoch int, loss double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = curriculum.stream(source, "run", "loss").writeStream.format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.stage, r.event) for r in spark.table("stages").collect()) == sorted(batch)

"""JSON Lines in and out, with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.operators.sampling import placed

CORRUPT = "_corrupt_record"
#: The core record of a function sample; a missing key reads as null.
SAMPLE = (
    "binary string, func_name string, opt_level string, source_file string, bin_opcodes array<int>, bin_operand_types array<int>, bin_operand_values array<int>, bin_instr_text array<array<string>>, "
    "bin_block_lengths array<int>, bin_edge_index array<array<int>>, bin_edge_type array<int>, bin_struct_features array<array<double>>, pattern_labels array<int>, src_token_ids array<int>, src_stmt_lengths array<int>, "
    "src_ast_types array<int>, src_edge_index array<array<int>>, src_edge_type array<int>, block_src_lines array<array<int>>, block_src_confidence array<array<double>>, source_lines array<int>, src_encoding_tier string, "
    "bb_alignment_coverage double, alignment_matrix array<array<double>>, alignment_confidence array<array<double>>, "
    "signal_stats struct<n_both:bigint,n_agree:bigint,n_near:bigint,n_conflict:bigint,n_dwarf_only:bigint,n_ir_only:bigint,n_none:bigint>, sft_input_ids array<int>, sft_labels array<int>, slot_types array<string>"
)


def strict(spark: SparkSession, paths: str | list[str], schema: str = SAMPLE) -> DataFrame:
    """Blank lines are skipped; a line that doesn't parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def lenient(spark: SparkSession, paths: str | list[str], schema: str = SAMPLE) -> DataFrame:
    """Lines that don't parse stay as rows whose `_corrupt_record` holds the line; count or drop them."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(paths)


def raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines byte for byte, blank ones left out, with their file and `offset_hint` (an order within the file)."""
    lines = spark.read.text(paths).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.where(F.trim("raw") != "")


def numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with `line`, their number over all files in the order of path and place, found from partition sizes."""
    rows = raw(spark, paths)
    key = F.struct("file", "block", "at")
    return placed(rows.withColumn("_order", key), "_order").select("file", F.col("_place").alias("line"), "raw")


def parsed(rows: DataFrame, schema: str = SAMPLE, line: str = "raw") -> DataFrame:
    """Add `rec` from raw lines; null where a line doesn't parse. The line itself stays for writing it back unchanged."""
    return rows.withColumn("rec", F.from_json(line, schema, {"mode": "PERMISSIVE"}))


def at_lines(rows: DataFrame, lines: list[int]) -> DataFrame:
    """Rows at given line numbers (a short list)."""
    return rows.where(F.col("line").isin(lines))


def first_found(roots: dict[int, DataFrame], key: str) -> DataFrame:
    """Of catalogues by root rank, each key's row of the smallest rank."""
    every = None
    for rank, df in roots.items():
        df = df.withColumn("root_rank", F.lit(rank))
        every = df if every is None else every.unionByName(df)
    return every.groupBy(key).agg(F.min_by(F.struct(*[c for c in every.columns if c != key]), F.col("root_rank")).alias("_x")).select(key, "_x.*")


def expected_grid(spark: SparkSession, projects: list[str], levels: list[str], pattern: str = "{project}_{level}.jsonl") -> DataFrame:
    """A row per project and level with its expected file name; built from two short lists."""
    return spark.createDataFrame([(p, x, pattern.format(project=p, level=x)) for p in projects for x in levels], "project string, level string, file string")


def with_missing(grid: DataFrame, found: DataFrame) -> DataFrame:
    """Left join of the grid to found files (file, ...); absent ones say MISSING."""
    out = grid.join(found.withColumn("_f", F.lit(True)), "file", "left")
    return out.withColumn("status", F.when(F.col("_f"), "ok").otherwise("MISSING")).drop("_f")


def preferred(grid: DataFrame, better: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """The better catalogue's value, else the other's."""
    x, y = better.select(key, F.col(value).alias("_a")), other.select(key, F.col(value).alias("_b"))
    return grid.join(x, key, "left").join(y, key, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def ir_blocks(spark: SparkSession, paths: str) -> DataFrame:
    """Blocks of text IR: func, label, lines (distinct !dbg line numbers in order), first_line. One file is one row, parsed by built-in functions."""
    text = spark.read.text(paths, wholetext=True)
    body = F.explode(F.expr(r"regexp_extract_all(value, '(?ms)^define [^@]*@[^\\n]*?\\{.*?^\\}', 0)"))
    funcs = text.select(F.expr(r"map_from_entries(transform(regexp_extract_all(value, '(?m)^!\\d+ = !DILocation\\(line: \\d+', 0), x -> struct(regexp_extract(x, '^!(\\d+)', 1), int(regexp_extract(x, 'line: (\\d+)', 1)))))").alias("loc"), body.alias("body"))
    parts = funcs.select("loc", F.regexp_extract("body", r'^define [^@]*@"?([^"(]+)', 1).alias("func"), F.posexplode(F.split("body", r"(?m)^(?=[\w.$-]+:)")).alias("k", "part"))
    label = F.when(F.col("k") == 0, "entry").otherwise(F.regexp_extract("part", r"^([\w.$-]+):", 1))
    lines = F.expr(r"array_distinct(filter(transform(regexp_extract_all(part, '!dbg !(\\d+)', 1), x -> loc[x]), x -> x IS NOT NULL))")
    rows = parts.where(F.col("part").contains("\n")).select("func", F.col("k").alias("ord"), label.alias("label"), lines.alias("lines"))
    return rows.withColumn("first_line", F.get("lines", F.lit(0)))


def write_raw(rows: DataFrame, path: str, line: str = "raw") -> None:
    rows.select(line).write.text(path)


def sorted_keys(c: Column, kind: T.DataType) -> Column:
    """A value whose structs, at any depth, have their fields in the order of their names."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[sorted_keys(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_keys(x, kind.elementType))
    return c


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with keys in the order of their names, nested ones too."""
    return F.to_json(F.struct(*[sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]))


def write_sorted_keys(df: DataFrame, path: str) -> None:
    """JSON with keys in the order of their names, nested ones too."""
    df.select(canonical_json(df).alias("value")).write.text(path)


def write_by(df: DataFrame, path: str, by: str, known: list[str], otherwise: str = "unknown", combined: bool = False) -> DataFrame:
    """One folder per known value and one for the rest, under `path`; with `combined` all rows under `path`/combined, too (the others then under `path`/parts).

    Returns a manifest read back from what was written: part, n_rows, and a digest of the rows that does not depend on their order.
    """
    rows = df.withColumn("part", F.when(F.col(by).isin(known), F.col(by)).otherwise(otherwise))
    parts = f"{path}/parts" if combined else path
    rows.write.partitionBy("part").json(parts)
    if combined:
        df.write.json(f"{path}/combined")
    lines = df.sparkSession.read.text(parts)
    if "part" not in lines.columns:  # nothing was written
        lines = lines.withColumn("part", F.lit(None).cast("string"))
    return lines.groupBy("part").agg(F.count("*").alias("n_rows"), F.sum(F.crc32("value")).alias("digest"))


def write_shards(df: DataFrame, path: str, rows: int = 4096) -> DataFrame:
    """Parquet shards of `rows` rows at most; returns a manifest of files with their row counts and a hash of their rows (in any order), checked against the input's number of rows."""
    spark = df.sparkSession
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    shards = spark.read.parquet(path)
    row_hash = F.xxhash64(*[c for c, t in shards.dtypes if "map<" not in t])
    manifest = shards.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"), F.first("_metadata.file_size").alias("bytes"), F.sum(row_hash.cast("decimal(20,0)")).alias("hash"))
    if (n := df.count()) != (m := shards.count()):
        raise RuntimeError(f"{m} of {n} rows were written")
    return manifest


def markdown_table(report: DataFrame) -> str:
    """A short report as a Markdown table, in the order of its rows."""
    rows = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in report.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [report.columns, ["-"] * len(report.columns), *rows])


def pretty_array(df: DataFrame, order: str) -> str:
    """A small table as one indented JSON array, in an order."""
    rows = [json.loads(r[0]) for r in df.orderBy(order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]
    return json.dumps(rows, ensure_ascii=False, indent=2)


def write_report(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.option("sep", separator).option("header", True).csv(path)


def file_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files with their size and lines."""
    return spark.read.text(paths).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.first("_metadata.file_size").alias("bytes"), F.count("*").alias("n_lines"))


def provenance(df: DataFrame, **tags: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def only_keys(df: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Listed columns; defaults fill nulls and add what is missing."""
    names = [*keys, *[k for k in defaults if k not in keys]]
    return df.select(*[F.coalesce(*([F.col(k)] if k in df.columns else []), *([defaults[k]] if k in defaults else []), F.lit(None)).alias(k) for k in names])

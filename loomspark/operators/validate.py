"""Shape rules of the core record: the first rule that a row breaks, at three levels of requirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_WIDTH = 12


def _n(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _sum(c: str) -> Column:
    return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))


def _pair_ok(c: str, kinds: str) -> list[tuple[Column, str]]:
    e = F.col(c)
    return [
        (F.coalesce(F.size(e) != 2, F.lit(True)), f"{c} is not a pair"),
        (F.size(F.get(e, F.lit(0))) != F.size(F.get(e, F.lit(1))), f"{c} halves differ in length"),
        (F.size(F.get(e, F.lit(0))) != _n(kinds), f"{kinds} does not match {c}"),
    ]


def source_present() -> Column:
    """Statement lengths exist and add up to the tokens."""
    return (_n("src_stmt_lengths") > 0) & (_sum("src_stmt_lengths") == _n("src_token_ids"))


def first_error(need_source: bool = False, need_alignment: bool = False, need_sft: bool = False, most_tokens: int = 4096) -> Column:
    """Message of the first broken rule, else null. Alignment needs the source side, supervised rows need both."""
    need_alignment = need_alignment or need_sft
    need_source = need_source or need_alignment
    blocks, instructions = _n("bin_block_lengths"), _sum("bin_block_lengths")
    rules = [
        (blocks == 0, "no blocks"),
        (_n("bin_opcodes") != instructions, "opcodes do not add up"),
        (_n("bin_operand_types") != 3 * instructions, "operand types are not 3 per instruction"),
        (_n("bin_operand_values") != 3 * instructions, "operand values are not 3 per instruction"),
        (_n("pattern_labels") != blocks, "labels do not match blocks"),
        (_n("bin_struct_features") != blocks, "features do not match blocks"),
        (F.exists("bin_struct_features", lambda f: F.size(f) != FEATURE_WIDTH), "features are not 12 wide"),
        *_pair_ok("bin_edge_index", "bin_edge_type"),
    ]
    if need_source:
        rules += [(~source_present(), "source side missing"), (_n("src_ast_types") != _n("src_stmt_lengths"), "syntax types do not match statements"), *_pair_ok("src_edge_index", "src_edge_type")]
    if need_alignment:
        width = _n("src_stmt_lengths")
        for m in ("alignment_matrix", "alignment_confidence"):
            rules += [(_n(m) != blocks, f"{m} rows do not match blocks"), (F.exists(m, lambda r: F.size(r) != width), f"{m} is not as wide as the statements")]
    if need_sft:
        rules += [(_n("sft_input_ids") != _n("sft_labels"), "supervised ids and labels differ"), (_n("sft_input_ids") == 0, "no supervised ids"), (_n("sft_input_ids") > most_tokens, "too many supervised ids"), (F.col("slot_types").isNull(), "slot types are missing")]
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), message) for broken, message in rules], F.lit(None).cast("string"))


def checked(samples: DataFrame) -> DataFrame:
    """Add error, error_source, error_alignment, error_sft: the first broken rule at each level."""
    return samples.withColumns({"error": first_error(), "error_source": first_error(True), "error_alignment": first_error(need_alignment=True), "error_sft": first_error(need_sft=True)})


def cells(samples: DataFrame, *keys: str) -> DataFrame:
    """Sparse cells of the alignment: keys, b, s, m, w, those with mass alone."""
    rows = samples.select(*keys, F.posexplode("alignment_matrix").alias("b", "_r"), "alignment_confidence").select(*keys, "b", F.get("alignment_confidence", F.col("b")).alias("_w"), F.posexplode("_r").alias("s", "m"))
    return rows.where("m > 0").select(*keys, "b", "s", "m", F.coalesce(F.get("_w", F.col("s")), F.lit(0.0)).alias("w"))


def edges(samples: DataFrame, *keys: str, index: str = "bin_edge_index", kinds: str = "bin_edge_type") -> DataFrame:
    """Edge rows: keys, n, src, dst, etype."""
    zipped = F.arrays_zip(F.get(index, F.lit(0)).alias("src"), F.get(index, F.lit(1)).alias("dst"), F.col(kinds).alias("etype"))
    return samples.select(*keys, F.posexplode(zipped).alias("n", "e")).select(*keys, "n", "e.src", "e.dst", "e.etype")


def blocks(samples: DataFrame, *keys: str) -> DataFrame:
    """Block rows: keys, b, first instruction, length, pattern label; the flat arrays are cut by running sums."""
    rows = samples.select(*keys, F.posexplode(F.arrays_zip("bin_block_lengths", "pattern_labels")).alias("b", "x"), "bin_block_lengths")
    first = F.aggregate(F.slice("bin_block_lengths", F.lit(1), F.col("b")), F.lit(0), lambda s, x: s + x)
    return rows.select(*keys, "b", first.alias("first"), F.col("x.bin_block_lengths").alias("length"), F.col("x.pattern_labels").alias("label"))

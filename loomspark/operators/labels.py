"""Block roles and statements: mapping lines to statements, refining and repairing roles, compatibility of roles and statement types.

Blocks are rows (sample, b, ...). Passes are columns in their order of precedence; joins replace loops over neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import gap_clusters

# Roles of blocks, types of statements, types of edges, by number.
ROLES = ["sequential", "if_header", "if_then_body", "if_else_body", "loop_header", "loop_body", "loop_exit", "switch_header", "switch_case_body", "function_prologue_epilogue"]
STATEMENTS = ["expr", "decl", "if", "while", "for", "do_while", "switch", "case", "return", "break", "continue", "goto", "compound", "call", "assign", "other"]
EDGES = ["cond", "uncond", "back", "call", "ret"]
# Statement types that a role may stand for.
COMPATIBLE = {
    "sequential": ["expr", "decl", "assign", "call", "other"],
    "if_header": ["if"],
    "if_then_body": ["expr", "decl", "assign", "call", "compound", "other"],
    "if_else_body": ["expr", "decl", "assign", "call", "compound", "other"],
    "loop_header": ["while", "for", "do_while"],
    "loop_body": ["expr", "decl", "assign", "call", "compound", "other"],
    "loop_exit": ["break", "continue", "return", "other"],
    "switch_header": ["switch"],
    "switch_case_body": ["case", "expr", "break", "other"],
    "function_prologue_epilogue": ["return", "decl", "other"],
}
# Patterns of source text.
IF, LOOP, SWITCH = r"\bif\s*\(", r"\b(for|while)\s*\(|\bdo\b", r"\bswitch\s*\("
CASE, TERMINAL, LEAVES = r"\bcase\b[^:]*:|default\s*:", r"\b(return|break|continue|goto)\b", r"\b(break|continue)\b"
SEQUENTIAL, IF_HEADER, IF_THEN, IF_ELSE, LOOP_HEADER, LOOP_BODY, LOOP_EXIT, SWITCH_HEADER, SWITCH_CASE, FUNC_END = range(10)


def compatibility(spark) -> DataFrame:
    """Bridge table (role, ast) of compatible numbers: a few dozen rows."""
    return spark.createDataFrame([(ROLES.index(r), STATEMENTS.index(s)) for r, kinds in COMPATIBLE.items() for s in kinds], "role int, ast int")


def compatible_cells(cells: DataFrame, spark) -> DataFrame:
    """Cells (role, ast, ...) whose types go together."""
    return cells.join(F.broadcast(compatibility(spark)), ["role", "ast"], "left_semi")


def type_penalty(shares: DataFrame, statements: DataFrame, _spark, keys: list[str]) -> DataFrame:
    """For each block and statement 1 - the share of roles (keys, b, role, p) that go with the statement's type (keys, s, ast); blocks meet the statements of their own sample."""
    kinds = [[ROLES.index(r) for r, fit in COMPATIBLE.items() if k in fit] for k in STATEMENTS]
    # a block's share for every type is one fixed row, so blocks are grouped once and meet their statements once
    mass = shares.groupBy(*keys, "b").agg(F.array(*(F.sum(F.when(F.col("role").isin(*k), F.col("p"))) for k in kinds)).alias("_c"))
    pairs = mass.join(statements.select(*keys, "s", "ast"), keys)
    return pairs.select(*keys, "b", "s", F.round(1 - F.coalesce(F.get("_c", F.col("ast")), F.lit(0.0)), 6).alias("penalty"))


def lines_to_statement(lines: DataFrame, statements: DataFrame, sample: str = "sample") -> DataFrame:
    """One statement and confidence per block: lines (sample, b, line); statements (sample, id, compound, control, depth, start_line, end_line).

    Each line stands for its deepest statement that is no compound (then its deepest), the shorter of equals, then the smaller id. One statement in all:
    0.95. Else, compounds dropped unless all are: a single control statement: 0.85; else the deepest, 0.80 if it is alone at its depth, the shortest of
    several, 0.60.
    """
    on_line = statements.withColumn("line", F.explode(F.sequence("start_line", "end_line")))
    hit = lines.select(sample, "b", "line").distinct().join(on_line, [sample, "line"])
    span = F.col("end_line") - F.col("start_line")
    pick = F.struct(F.col("compound").alias("k"), (-F.col("depth")).alias("d"), span.alias("w"), F.col("id").alias("i"))
    row = F.struct("id", "compound", "control", "depth", span.alias("span"))
    best = hit.groupBy(sample, "b", "line").agg(F.min_by(row, pick).alias("x")).select(sample, "b", "x.*").distinct()
    plain = best.groupBy(sample, "b").agg(F.count("*").alias("n"), F.bool_or(~F.col("compound")).alias("some"))
    pool = best.join(plain, [sample, "b"]).where((F.col("n") == 1) | ~(F.col("some") & F.col("compound")))
    deep = pool.groupBy(sample, "b").agg(
        F.count("*").alias("left"),
        F.count_if("control").alias("n_control"),
        F.max(F.when(F.col("control"), F.col("id"))).alias("the_control"),
        F.min_by("id", F.struct((-F.col("depth")).alias("d"), "span", "id")).alias("deepest"),
        F.max("depth").alias("depth"),
        F.first("id").alias("any"),
    )
    at_depth = pool.join(deep.select(sample, "b", F.col("depth")), [sample, "b", "depth"]).groupBy(sample, "b").agg(F.count("*").alias("n_deep"))
    d = deep.join(at_depth, [sample, "b"])
    one, control = F.col("left") == 1, F.col("n_control") == 1
    return d.select(
        sample,
        "b",
        F.when(one, F.col("any")).when(control, F.col("the_control")).otherwise(F.col("deepest")).alias("id"),
        F.when(one, 0.95).when(control, 0.85).when(F.col("n_deep") == 1, 0.8).otherwise(0.6).alias("confidence"),
    )


def assigned(blocks: DataFrame, edges: DataFrame, headers: DataFrame, sample: str = "sample") -> DataFrame:
    """First roles of blocks (sample, b): loop headers, sequential blocks with a back edge (sample, src, dst, etype 2) to one as loop bodies, all others sequential."""
    h = headers.select(sample, "b").distinct()
    bodies = edges.where("etype = 2").join(h.withColumnRenamed("b", "dst"), [sample, "dst"]).select(sample, F.col("src").alias("b")).distinct().withColumn("_body", F.lit(True))
    out = blocks.select(sample, "b").join(h.withColumn("_head", F.lit(True)), [sample, "b"], "left").join(bodies, [sample, "b"], "left")
    return out.select(sample, "b", F.when(F.col("_head"), LOOP_HEADER).when(F.col("_body"), LOOP_BODY).otherwise(SEQUENTIAL).cast("int").alias("role"))


def canonical_headers(candidates: DataFrame, lines: DataFrame, pattern: str, sample: str = "sample") -> DataFrame:
    """Of candidates (sample, b, preferred) one for each source line (sample, b, line, text) whose text, without comments, has the pattern: a preferred one, then the smallest b.

    Candidates without such a line all stay.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, r"(?m)//.*?$", " ")
    hit = candidates.join(lines.where(F.rlike(text, F.lit(pattern))).select(sample, "b", "line"), [sample, "b"])
    best = hit.groupBy(sample, "line").agg(F.min_by("b", F.struct((~F.col("preferred")).alias("p"), "b")).alias("b")).select(sample, "b")
    rest = candidates.join(hit.select(sample, "b"), [sample, "b"], "left_anti").select(sample, "b")
    return best.union(rest).distinct()


def switch_evidence(blocks: DataFrame, edges: DataFrame, lines: DataFrame, sample: str = "sample", gap: int = 3) -> DataFrame:
    """Blocks (sample, b, role, text, indirect) with `switch_header` and `switch_case`, the sets that repair starts from.

    Headers: canonical blocks on a switch line, preferring dispatching ones (indirect jumps, 3 or more successors); without any in a sample the dispatching ones; without
    those the first of each cluster of old headers (at most `gap` apart). A cluster without a header gets its first block. Cases: what looks like a case, and the
    other old headers of a cluster.
    """
    wide = edges.select(sample, "src", "dst").groupBy(sample, F.col("src").alias("b")).agg((F.count("*") >= 3).alias("_wide"))
    x = blocks.join(wide, [sample, "b"], "left").withColumn("preferred", F.coalesce("indirect", F.lit(False)) | F.coalesce("_wide", F.lit(False)))
    text = F.coalesce("text", F.lit(""))
    found = canonical_headers(x.where(F.rlike(text, F.lit(SWITCH))).select(sample, "b", "preferred"), lines, SWITCH, sample)
    some = found.select(sample).distinct().withColumn("_some", F.lit(True))
    dispatch = x.where("preferred").join(some, sample, "left_anti").select(sample, "b")
    headers = found.union(dispatch).withColumn("_h", F.lit(True))
    old = x.where(F.col("role") == SWITCH_HEADER).select(sample, "b")
    clusters = gap_clusters(old, [sample], "b", gap).join(headers, [sample, "b"], "left")
    first = F.coalesce(F.min(F.when(F.col("_h"), F.col("b"))), F.min("b"))
    chosen = clusters.groupBy(sample, "cluster").agg(first.alias("_first"))
    chain = clusters.join(chosen, [sample, "cluster"]).select(sample, "b", (F.col("b") == F.col("_first")).alias("_canonical"))
    out = x.join(headers, [sample, "b"], "left").join(chain, [sample, "b"], "left")
    head = F.coalesce("_h", F.lit(False)) | F.coalesce("_canonical", F.lit(False))
    case = F.rlike(text, F.lit(CASE)) | F.coalesce(~F.col("_canonical"), F.lit(False))
    return out.select(*blocks.columns, head.alias("switch_header"), (case & ~head).alias("switch_case"))


def loop_evidence(blocks: DataFrame, edges: DataFrame, lines: DataFrame, sample: str = "sample") -> DataFrame:
    """Blocks (sample, b, structural) with `loop_header`: targets of back edges and structural headers, one for each source line of a loop, targets preferred; `back_source`."""
    back = edges.where("etype = 2")
    targets = back.select(sample, F.col("dst").alias("b")).distinct().withColumn("preferred", F.lit(True))
    x = blocks.join(targets, [sample, "b"], "left").withColumn("preferred", F.coalesce("preferred", F.lit(False)))
    found = canonical_headers(x.where(F.col("preferred") | F.coalesce("structural", F.lit(False))).select(sample, "b", "preferred"), lines, LOOP, sample).withColumn("_h", F.lit(True))
    sources = back.select(sample, F.col("src").alias("b")).distinct().withColumn("_s", F.lit(True))
    out = blocks.join(found, [sample, "b"], "left").join(sources, [sample, "b"], "left")
    return out.select(*blocks.columns, F.coalesce("_h", F.lit(False)).alias("loop_header"), F.coalesce("_s", F.lit(False)).alias("back_source"))


def refined(blocks: DataFrame, edges: DataFrame, sample: str = "sample") -> DataFrame:
    """Roles of sequential blocks out of their statements: blocks (sample, b, role, s, ast), s null if not aligned; edges (sample, src, dst, etype). Adds `refined`.

    First each block by its own statement (a branch of an `if`, or the one block behind such a branch on the same statement, a loop, a switch, a case, an end
    without successors); then blocks behind an if header: on its statement, or early leaves towards an end: then; other single successors: else.
    """
    e = edges.select(sample, "src", "dst", "etype")
    out = e.groupBy(sample, F.col("src").alias("b")).agg(F.count("*").alias("n_out"), F.bool_or(F.col("etype") == 0).alias("branches"), F.min("dst").alias("one_dst"))
    into = e.groupBy(sample, F.col("dst").alias("b")).agg(F.count("*").alias("n_in"), F.min("src").alias("one_src"))
    x = blocks.join(out, [sample, "b"], "left").join(into, [sample, "b"], "left").na.fill(0, ["n_out", "n_in"]).withColumn("branches", F.coalesce("branches", F.lit(False)))
    before = x.select(sample, F.col("b").alias("one_src"), F.col("branches").alias("p_branches"), F.col("s").alias("p_s"))
    x = x.join(before, [sample, "one_src"], "left")
    a = F.col("ast")
    own = (
        F.when((a == 2) & F.col("branches"), IF_HEADER).when((a == 2) & (F.col("n_in") == 1) & F.col("p_branches") & (F.col("p_s") == F.col("s")), IF_THEN)
        .when(a.isin(3, 4, 5), LOOP_HEADER).when(a == 6, SWITCH_HEADER).when(a == 7, SWITCH_CASE).when(a.isin(8, 9, 10, 11) & (F.col("n_out") == 0), FUNC_END)
    )
    x = x.withColumn("r1", F.when((F.col("role") == SEQUENTIAL) & F.col("s").isNotNull(), F.coalesce(own, F.col("role"))).otherwise(F.col("role")))
    headers = x.where(f"r1 = {IF_HEADER} AND ast = 2").select(sample, F.col("b").alias("src"), F.col("s").alias("h_s"))
    behind = e.join(headers, [sample, "src"]).groupBy(sample, F.col("dst").alias("b")).agg(F.collect_set("h_s").alias("h"))
    ends = x.select(sample, F.col("b").alias("one_dst"), (F.col("n_out") == 0).alias("to_end"))
    x = x.join(behind, [sample, "b"], "left").join(ends, [sample, "one_dst"], "left")
    open_ = (F.col("r1") == SEQUENTIAL) & F.col("s").isNotNull() & F.col("h").isNotNull()
    early = a.isin(8, 9, 10, 11) & (F.col("n_out") == 1) & F.coalesce("to_end", F.lit(False))
    second = F.when(F.array_contains("h", F.col("s")), IF_THEN).when((F.col("n_in") == 1) & early, IF_THEN).when(F.col("n_in") == 1, IF_ELSE)
    return x.withColumn("refined", F.when(open_, F.coalesce(second, F.col("r1"))).otherwise(F.col("r1"))).select(*blocks.columns, "refined")


def repaired(blocks: DataFrame, sample: str = "sample") -> DataFrame:
    """Ordered repair passes over blocks (sample, b, role, text, branches, n_out, back_source, loop_header, loop_exit, switch_header, switch_case). Adds `repaired`.

    Headers and cases are the canonical sets that the caller chose (see align.canonical and align.gap_clusters). Demote headers that are not canonical,
    promote canonical ones, then loop bodies and exits, leaves, supported ifs and function ends, each pass leaving stronger roles alone.
    """
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    has = lambda p: F.rlike(text, F.lit(p))
    if_ok = has(IF) & F.col("branches")
    demoted_loop = F.when(if_ok, IF_HEADER).when(has(CASE), SWITCH_CASE).when(has(TERMINAL) & (F.col("loop_exit") | (F.col("n_out") == 0)), LOOP_EXIT).otherwise(SEQUENTIAL)
    demoted_switch = F.when(has(CASE), SWITCH_CASE).when(if_ok, IF_HEADER).otherwise(SEQUENTIAL)
    steps: list[tuple[Column, Column]] = [
        ((role == LOOP_HEADER) & ~F.col("loop_header"), demoted_loop),
        ((role == SWITCH_HEADER) & ~F.col("switch_header"), demoted_switch),
        (F.col("loop_header"), F.lit(LOOP_HEADER)),
        (F.col("switch_header"), F.lit(SWITCH_HEADER)),
        (F.col("switch_case") & ~F.col("switch_header"), F.lit(SWITCH_CASE)),
    ]
    now = role
    for when, to in steps:
        now = F.when(when, to).otherwise(now)
    out = blocks.withColumn("_r", now)
    weak = F.col("_r").isin(SEQUENTIAL, IF_THEN, IF_ELSE)
    held = F.col("_r").isin(IF_HEADER, LOOP_HEADER, LOOP_BODY, LOOP_EXIT, SWITCH_HEADER, SWITCH_CASE)
    for when, to in (
        (weak & F.col("back_source"), LOOP_BODY),
        (weak & F.col("loop_exit"), LOOP_EXIT),
        (~held & has(LEAVES), LOOP_EXIT),
        (~F.col("_r").isin(LOOP_HEADER, SWITCH_HEADER, SWITCH_CASE) & if_ok, IF_HEADER),
        (~held & has(TERMINAL) & (F.col("n_out") == 0), FUNC_END),
    ):
        out = out.withColumn("_r", F.when(when, F.lit(to)).otherwise(F.col("_r")))
    return out.withColumnRenamed("_r", "repaired")


def confusion(df: DataFrame, gold: str, found: str) -> DataFrame:
    return df.groupBy(gold, found).agg(F.count("*").alias("n"))


def remapped(rows: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Rows that are referenced, renumbered from 1 in the order of their key, the old key kept; a reference without a row fails the job."""
    wanted = referenced.select(key).distinct()
    lost = wanted.join(rows.select(key), key, "left_anti")
    if (n := lost.count()) > 0:
        raise ValueError(f"{n} referenced rows are missing")
    from .sampling import placed

    return placed(rows.join(wanted, key, "left_semi"), key).select((F.col("_place") + 1).alias("new_id"), *rows.columns)


def cost_components(score: Column, rewrite: Column, n_blocks: Column, condition: Column, available: Column) -> Column:
    """Matching costs as a struct of values; what needs evidence that is not there is null and named in `unavailable`."""
    # fixed values: costs and names of what is not computed here
    need = ["live_in", "live_out", "read_write", "effect", "cfg_successor", "dominance", "pdg_dependency", "verifier_confidence"]
    known = lambda c: F.when(available, c)
    return F.struct(
        known(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - score))).alias("semantic_distance"),
        known(F.when(rewrite, 0.12).otherwise(0.0)).alias("rewrite_cost"),
        known(F.when(rewrite, 0.05).otherwise(0.0)).alias("rewrite_bonus"),
        known(F.least(F.lit(0.1), 0.02 * n_blocks)).alias("block_bonus"),
        known(F.when(condition, F.lit(None).cast("double")).otherwise(0.0)).alias("polarity"),
        F.when(available, F.array(*map(F.lit, need))).otherwise(F.array(F.lit("all"))).alias("unavailable"),
    )

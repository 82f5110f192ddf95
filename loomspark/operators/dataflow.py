"""Dataflow of functions: liveness, reaching definitions, chains from definitions to uses, and what regions read, write and pass on.

Blocks, edges and accesses are rows of all functions at once. A fact (a value, or a place that defines it) leaves a block along its edges and goes on from where it arrives unless that block
defines the value. A function of up to LARGEST rows is followed to its end where its rows meet, by a worklist over sets of facts, many functions in a batch: one shuffle, however far facts go. Larger ones go
in semi-naive rounds: only facts that arrived somewhere for the first time move on, joined with the edges; a round in which none did is the last. liveness and region_flow gather a function's rows as one row
and make their results from it, so nothing between is shuffled or kept; tables that were dealt by function before, in equal parts, are not shuffled at all.

Tables: edges (sample, src, dst); accesses (sample, block, ordinal, value, kind), kind `def` or `use`, where of one ordinal the uses come before the definitions; regions (sample, region, block), which may overlap.

Cases: repeated rows count once. Rows with a null sample, block or value are no facts. Edges to blocks without accesses are ways like others; blocks that nothing reaches have facts of their own.
A value that is used without any definition comes from outside the function. A function that is one huge component only adds rounds. Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import in_batches, larger, whole
from .settle import released, settled

#: Edges, leaving facts and stops of a function that is followed in one place.
LARGEST = 20_000


def _plain(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns).na.drop().distinct()


def _followed(what: list[int], block: list, dst: list, facts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Of a function's rows (what: 0 edge, 1 leaving fact, 2 stop) pairs of places: a row whose dst is a block, and one whose fact arrives there."""
    out, at, bits, rows = defaultdict(list), {}, {}, []
    leaving, of_value, stops = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, w in enumerate(what):
        if w == 0:
            out[block[i]].append(dst[i])
            at[dst[i]] = i
        elif w == 1:
            k = bits.setdefault(facts[i], len(rows))
            if k == len(rows):
                rows.append(i)
                of_value[facts[i][0]] |= 1 << k
            leaving[block[i]] |= 1 << k
    for i, w in enumerate(what):
        if w == 2:
            stops[block[i]] |= of_value.get(facts[i][0], 0)
    found, todo = dict.fromkeys(at, 0), deque(leaving)
    while todo:
        b = todo.popleft()
        moving = leaving.pop(b)
        for d in out.get(b, ()):
            new = moving & ~found[d]
            found[d] |= new
            on = new & ~stops.get(d, 0)
            if on:
                if d not in leaving:
                    todo.append(d)
                leaving[d] |= on
    if not (at and rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = (len(rows) + 7) // 8
    packed = np.frombuffer(b"".join(x.to_bytes(width, "little") for x in found.values()), np.uint8).reshape(-1, width)
    b, k = np.nonzero(np.unpackbits(packed, axis=1, bitorder="little"))
    return np.array(list(at.values()))[b], np.array(rows)[k]


def _following(fact: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole(batches):
            what, block, dst = (table[c].to_pylist() for c in ("what", "block", "dst"))
            facts = list(zip(*(table[c].to_pylist() for c in fact), strict=True))
            for a, z in pairwise(starts):
                b, k = _followed(what[a:z], block[a:z], dst[a:z], facts[a:z])
                if len(b):
                    found = {"sample": table["sample"].take(b + a), "block": table["dst"].take(b + a), **{c: table[c].take(k + a) for c in fact}}
                    yield from pa.table(found).to_batches(max_chunksize=100_000)

    return run


def arrived(leaving: DataFrame, edges: DataFrame, stops: DataFrame, fact: list[str]) -> tuple[DataFrame, int]:
    """(sample, block, *fact) of all facts that arrive at blocks, as a table of the shared folder, and how many rounds functions of more than LARGEST rows took.

    leaving: (sample, block, *fact) of facts at the ends of the blocks where they begin; stops: (sample, block, value), where facts of that value, `fact[0]`, go no further.
    """
    kinds = dict(leaving.dtypes)
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    what = lambda k: F.lit(k).cast("tinyint").alias("what")
    kept = lambda rows, *c: rows.select("sample", *c).na.drop()
    ways = kept(edges, F.col("src").cast(kinds["block"]).alias("block"), F.col("dst").cast(kinds["block"]).alias("dst")).select("sample", what(0), "block", "dst", *map(null, fact))
    begin = kept(leaving, "block", *fact).select("sample", what(1), "block", null("block").alias("dst"), *fact)
    end = kept(stops, "block", fact[0]).select("sample", what(2), "block", null("block").alias("dst"), fact[0], *map(null, fact[1:]))
    rows = settled(ways.unionByName(begin).unionByName(end))
    large = settled(larger(rows, LARGEST))
    some = not large.isEmpty()
    out = settled(in_batches(rows.join(large, "sample", "left_anti") if some else rows, _following(fact), ", ".join(f"`{c}` {kinds[c]}" for c in ("sample", "block", *fact))))
    rounds = 0
    if some:
        far = rows.join(large, "sample")
        more, rounds = _in_rounds(far.where("what = 1"), far.where("what = 0").withColumnRenamed("block", "src"), far.where("what = 2"), fact)
        out = out.unionByName(more)
    released(rows, large)
    return out, rounds


def _in_rounds(leaving: DataFrame, edges: DataFrame, stops: DataFrame, fact: list[str]) -> tuple[DataFrame, int]:
    key = ["sample", "block", *fact]
    ways = settled(_plain(edges, "sample", "src", "dst"))
    stops = settled(_plain(stops, "sample", "block", fact[0]))
    moving = settled(_plain(leaving, *key))
    parts: list[DataFrame] = []
    known, rounds = None, 0
    while not moving.isEmpty():
        rounds += 1
        steps = moving.join(ways.withColumnRenamed("src", "block"), ["sample", "block"]).select("sample", F.col("dst").alias("block"), *fact).distinct()
        new = settled(steps if known is None else steps.join(known, key, "left_anti"))
        released(moving)
        parts.append(new)
        known = new if known is None else known.unionByName(new)
        moving = settled(new.join(stops, ["sample", "block", fact[0]], "left_anti"))
        if len(parts) > 8:  # few tables, so that a round reads few files
            known = settled(known)
            released(*parts)
            parts = [known]
    out = settled(known if known is not None else moving)
    released(moving, ways, stops, *parts)
    return out, rounds


def exposed_uses(accesses: DataFrame) -> DataFrame:
    """(sample, block, ordinal, value) of uses that no definition in the block comes before."""
    use, first = F.col("kind") == "use", F.min(F.when(F.col("kind") == "def", F.col("ordinal"))).over(Window.partitionBy("sample", "block", "value"))
    return _plain(accesses.withColumn("_first", first).where(use & (F.col("_first").isNull() | (F.col("ordinal") <= F.col("_first")))), "sample", "block", "ordinal", "value")


def last_definitions(accesses: DataFrame) -> DataFrame:
    """(sample, block, value, ordinal) of the definitions that leave their block."""
    return accesses.where("kind = 'def'").na.drop(subset=["sample", "block", "value"]).groupBy("sample", "block", "value").agg(F.max("ordinal").alias("ordinal"))


def _definitions(accesses: DataFrame) -> DataFrame:
    return _plain(accesses.where("kind = 'def'"), "sample", "block", "value")


def _facts(accesses: DataFrame) -> DataFrame:
    """(sample, block, value, flags): 1 used before any definition in the block, 2 defined, 4 the definition has a place, 8 used behind a definition."""
    at = lambda kind: F.when(F.col("kind") == kind, F.col("ordinal"))
    x = accesses.na.drop(subset=["sample", "block", "value"]).groupBy("sample", "block", "value").agg(F.min(at("def")).alias("_first"), F.min(at("use")).alias("_least"), F.max(at("use")).alias("_most"), F.max(F.col("kind") == "def").alias("_def"))
    first = F.col("_first")
    held = {1: F.col("_least").isNotNull() & (first.isNull() | (F.col("_least") <= first)), 2: F.col("_def"), 4: first.isNotNull(), 8: F.col("_most") > first}
    flags = sum(F.when(c, k).otherwise(0) for k, c in held.items())
    return x.select("sample", "block", "value", flags.cast("tinyint").alias("flags")).where("flags > 0")


def _functions(accesses: DataFrame, edges: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """A row for each function: sample, facts, ways and areas (regions and their blocks), as arrays. Functions must be of bounded size."""
    kind = dict(accesses.dtypes)["block"]
    cast = lambda c: F.col(c).cast(kind).alias(c)
    tables = {"facts": _facts(accesses).select("sample", F.struct("block", "value", "flags").alias("facts")), "ways": edges.na.drop(subset=["sample", "src", "dst"]).select("sample", F.struct(cast("src"), cast("dst")).alias("ways"))}
    if regions is not None:
        tables["areas"] = regions.na.drop(subset=["sample", "region", "block"]).select("sample", F.struct("region", cast("block")).alias("areas"))
    kinds = {n: t.schema[n].dataType for n, t in tables.items()}
    rows = reduce(DataFrame.unionByName, (t.select("sample", *(F.col(c) if c == n else F.lit(None).cast(k).alias(c) for c, k in kinds.items())) for n, t in tables.items()))
    return rows.groupBy("sample").agg(*(F.collect_list(c).alias(c) for c in kinds))


def _split(sizes: DataFrame | None, *tables: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables' rows of functions of up to LARGEST rows in all, and those of larger ones, if there are any. Without sizes the rows are counted, which makes the tables once more."""
    over = larger(reduce(DataFrame.unionByName, (t.select("sample") for t in tables)), LARGEST) if sizes is None else sizes.where(F.col("n") > LARGEST).select("sample")
    large = settled(over.where("sample IS NOT NULL"))
    if large.isEmpty():
        released(large)
        return list(tables), None
    return [t.join(large, "sample", "left_anti") for t in tables], [t.join(large, "sample") for t in tables]


def _numbers(*columns: pa.Array) -> tuple[list[list[int]], Callable[[list[int]], pa.Array]]:
    """Numbers that stand for the values of columns of one type, in their order, and what gives the values of numbers."""
    kind = columns[0].type
    if pa.types.is_integer(kind):
        return [c.to_numpy().tolist() for c in columns], lambda n: pa.array(np.array(n, np.int64)).cast(kind)
    coded = pa.concat_arrays(columns).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    codes, ends = place[coded.indices.to_numpy()] if len(coded) else place, np.cumsum([0, *map(len, columns)])
    return [codes[a:z].tolist() for a, z in pairwise(ends)], lambda n: coded.dictionary.take(order.take(pa.array(n, pa.int64())))


def _parts(batch: pa.RecordBatch, *names: str) -> list[tuple[list[int], pa.StructArray]]:
    """Of columns of arrays where each function's begin, and their parts."""
    found = []
    for n in names:
        column = batch.column(n)
        offsets = column.offsets.to_numpy()
        found.append(((offsets - offsets[0]).tolist(), column.flatten()))
    return found


def _followed_back(facts: Iterator[tuple[int, int, int]], before: dict[int, list[int]]) -> tuple[dict, dict, dict, dict]:
    """bits by value, and by block the sets of values that are used first, defined, and live at the end."""
    bits, use, stop, out = {}, {}, {}, {}
    for b, v, f in facts:
        bit = 1 << bits.setdefault(v, len(bits))
        if f & 1:
            use[b] = use.get(b, 0) | bit
        if f & 2:
            stop[b] = stop.get(b, 0) | bit
    todo, moving = sorted(use), use.copy()
    while todo:
        b = todo.pop()
        new = moving.pop(b)
        for a in before.get(b, ()):
            held = out.get(a, 0)
            more = new & ~held
            if more:
                out[a] = held | more
                on = more & ~stop.get(a, 0)
                if on:
                    if a not in moving:
                        todo.append(a)
                    moving[a] = moving.get(a, 0) | on
    return bits, use, stop, out


def _living(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = (1 << 64) - 1
    for batch in batches:
        (fs, facts), (ws, ways) = _parts(batch, "facts", "ways")
        (block, src, dst), of_block = _numbers(facts.field("block"), ways.field("src"), ways.field("dst"))
        (value,), of_value = _numbers(facts.field("value"))
        flags = facts.field("flags").to_pylist()
        at, blocks, begin, end, base, values = [], [], [], [], [], []
        for i in range(batch.num_rows):
            a, z = fs[i], fs[i + 1]
            before = defaultdict(list)
            for x, y in zip(src[ws[i] : ws[i + 1]], dst[ws[i] : ws[i + 1]], strict=True):
                before[y].append(x)
            bits, use, stop, out = _followed_back(zip(block[a:z], value[a:z], flags[a:z], strict=True), before)
            for b in use.keys() | out.keys():
                o = out.get(b, 0)
                n = use.get(b, 0) | o & ~stop.get(b, 0)
                for k in range(0, len(bits), 64):
                    at.append(i)
                    blocks.append(b)
                    begin.append(n >> k & word)
                    end.append(o >> k & word)
                    base.append(len(values) + k)
            values += bits
        if not at:
            continue
        live_in, live_out = np.array(begin, np.uint64), np.array(end, np.uint64)
        r, k = np.nonzero(np.unpackbits((live_in | live_out).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        is_set = lambda x: pa.array((x[r] >> k.astype(np.uint64) & np.uint64(1)).astype(bool))  # noqa: B023, E731
        columns = [batch.column("sample").take(pa.array(np.array(at)[r])), of_block(np.array(blocks)[r]), of_value(np.array(values)[np.array(base)[r] + k]), is_set(live_in), is_set(live_out)]
        yield from pa.table(columns, ["sample", "block", "value", "live_in", "live_out"]).to_batches(max_chunksize=100_000)


def liveness(accesses: DataFrame, edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(sample, block, value, live_in, live_out) of the values that are live at a block's beginning or end.

    sizes: (sample, n), a row for each function and not less than its rows in all tables, if that is known without making them.
    """
    kinds = dict(accesses.dtypes)
    small, large = _split(sizes, accesses, edges)
    found = _functions(*small).mapInArrow(_living, ", ".join(f"{c} {kinds[c]}" for c in ("sample", "block", "value")) + ", live_in boolean, live_out boolean")
    return found if large is None else found.unionByName(_far_liveness(*large))


def _far_liveness(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    uses, defined = _plain(exposed_uses(accesses), "sample", "block", "value"), _definitions(accesses)
    back = edges.select("sample", F.col("dst").alias("src"), F.col("src").alias("dst"))
    out, _ = arrived(uses, back, defined, ["value"])
    through = out.join(defined, ["sample", "block", "value"], "left_anti")
    begin = uses.unionByName(through.select("sample", "block", "value")).distinct().withColumn("live_in", F.lit(True))
    end = out.select("sample", "block", "value").withColumn("live_out", F.lit(True))
    both = begin.join(end, ["sample", "block", "value"], "full")
    return both.select("sample", "block", "value", F.coalesce("live_in", F.lit(False)).alias("live_in"), F.coalesce("live_out", F.lit(False)).alias("live_out"))


def reaching_definitions(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, block, value, def_block, def_ordinal) of the definitions that reach a block's beginning."""
    leaving = last_definitions(accesses).select("sample", "block", "value", F.col("block").alias("def_block"), F.col("ordinal").alias("def_ordinal"))
    return arrived(leaving, edges, _definitions(accesses), ["value", "def_block", "def_ordinal"])[0]


def def_use_chains(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, value, use_block, use_ordinal, def_block, def_ordinal) of each use and each definition that it may see; without any the last two are null."""
    place = ["sample", "block", "value", "ordinal", "kind"]
    rows = _plain(accesses, *place)
    # within a block the last definition before the use
    before = F.max(F.when(F.col("kind") == "def", F.col("ordinal"))).over(Window.partitionBy("sample", "block", "value").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1))
    uses = rows.withColumn("_own", before).where("kind = 'use'")
    own = uses.where("_own IS NOT NULL").select("sample", "value", F.col("block").alias("use_block"), F.col("ordinal").alias("use_ordinal"), F.col("block").alias("def_block"), F.col("_own").alias("def_ordinal"))
    far = uses.where("_own IS NULL").join(reaching_definitions(accesses, edges), ["sample", "block", "value"], "left")
    return own.unionByName(far.select("sample", "value", F.col("block").alias("use_block"), F.col("ordinal").alias("use_ordinal"), "def_block", "def_ordinal"))


_SETS = ["live_in", "live_out", "internal_uses", "raw_defs", "raw_uses"]


def _flow(facts: list[tuple[int, int, int]], after: dict[int, list[int]], areas: dict[int, set[int]]) -> Iterator[tuple[set[int], ...]]:
    """Of each of a function's regions the sets of values in the order of _SETS."""
    leaving, of_value, defines, stop, at, found, seen = {}, {}, [], {}, defaultdict(list), {}, {}
    for b, v, f in facts:
        at[b].append((v, f))
        if f & 4:
            bit = 1 << len(defines)
            defines.append(v)
            of_value[v] = of_value.get(v, 0) | bit
            leaving[b] = leaving.get(b, 0) | bit
    for b, v, f in facts:
        if f & 2:
            stop[b] = stop.get(b, 0) | of_value.get(v, 0)
    todo, moving = sorted(leaving, reverse=True), leaving.copy()
    while todo:
        a = todo.pop()
        new = moving.pop(a)
        for b in after.get(a, ()):
            held = found.get(b, 0)
            more = new & ~held
            if more:
                found[b] = held | more
                on = more & ~stop.get(b, 0)
                if on:
                    if b not in moving:
                        todo.append(b)
                    moving[b] = moving.get(b, 0) | on
    for b, v, f in facts:  # the definitions that a block's uses see
        if f & 1 and b in found:
            seen[b] = seen.get(b, 0) | found[b] & of_value.get(v, 0)
    for blocks in areas.values():
        own, outside, sets = 0, 0, (set(), set(), set(), set(), set())
        live_in, live_out, internal, defs, uses = sets
        for b in blocks:
            own |= leaving.get(b, 0)
        for b, m in seen.items():
            if b not in blocks:
                outside |= m
        outside &= own
        while outside:
            k = outside.bit_length() - 1
            live_out.add(defines[k])
            outside &= ~of_value[defines[k]]
        for b in blocks:
            arrived_here = found.get(b, 0)
            for v, f in at.get(b, ()):
                if f & 1:
                    m = arrived_here & of_value.get(v, 0)
                    if m & own:
                        internal.add(v)
                    if not m or m & ~own:
                        live_in.add(v)
                if f & 8:
                    internal.add(v)
                if f & 9:
                    uses.add(v)
                if f & 2:
                    defs.add(v)
        yield sets


def _flowing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (fs, facts), (ws, ways), (rs, areas) = _parts(batch, "facts", "ways", "areas")
        (block, src, dst, inside), _ = _numbers(facts.field("block"), ways.field("src"), ways.field("dst"), areas.field("block"))
        (value,), of_value = _numbers(facts.field("value"))
        (region,), of_region = _numbers(areas.field("region"))
        flags = facts.field("flags").to_pylist()
        at, regions, ends, values = [], [], [[0] for _ in _SETS], [[] for _ in _SETS]
        for i in range(batch.num_rows):
            a, z = fs[i], fs[i + 1]
            after, own = defaultdict(list), defaultdict(set)
            for x, y in zip(src[ws[i] : ws[i + 1]], dst[ws[i] : ws[i + 1]], strict=True):
                after[x].append(y)
            for r, b in zip(region[rs[i] : rs[i + 1]], inside[rs[i] : rs[i + 1]], strict=True):
                own[r].add(b)
            at += [i] * len(own)
            regions += own
            for sets in _flow(list(zip(block[a:z], value[a:z], flags[a:z], strict=True)), after, own):
                for e, all_values, some in zip(ends, values, sets, strict=True):
                    all_values += sorted(some)
                    e.append(len(all_values))
        columns = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), of_value(v)) for e, v in zip(ends, values, strict=True)]
        yield from pa.table([batch.column("sample").take(pa.array(at, pa.int64())), of_region(regions), *columns], ["sample", "region", *_SETS]).to_batches(max_chunksize=10_000)


def region_flow(accesses: DataFrame, edges: DataFrame, regions: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Per (sample, region) sorted arrays of values: live_in (used inside, from outside), live_out (defined inside, used outside), internal_defs (defined inside, used outside nowhere),
    internal_uses (used inside, from inside), raw_defs and raw_uses (all defined and used inside). Every region of `regions` has a row. sizes as for liveness."""
    kinds = dict(accesses.dtypes)
    small, large = _split(sizes, accesses, edges, regions)
    schema = f"sample {kinds['sample']}, region {dict(regions.dtypes)['region']}, " + ", ".join(f"{n} array<{kinds['value']}>" for n in _SETS)
    found = _functions(*small).where(F.size("areas") > 0).mapInArrow(_flowing, schema)
    found = found.withColumn("internal_defs", F.array_except("raw_defs", "live_out")).select("sample", "region", "live_in", "live_out", "internal_defs", "internal_uses", "raw_defs", "raw_uses")
    return found if large is None else found.unionByName(_far_region_flow(*large))


def _far_region_flow(accesses: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    regions = _plain(regions, "sample", "region", "block")
    chains = settled(def_use_chains(accesses, edges))
    inside = lambda c, name: regions.select("sample", "region", F.col("block").alias(c), F.lit(True).alias(name))
    used = chains.join(inside("use_block", "u"), ["sample", "use_block"])
    used = used.join(inside("def_block", "d"), ["sample", "region", "def_block"], "left")
    defined = chains.where("def_block IS NOT NULL").join(inside("def_block", "d"), ["sample", "def_block"]).join(inside("use_block", "u"), ["sample", "region", "use_block"], "left")
    every = _plain(accesses.where("kind = 'def'"), "sample", "block", "value").join(regions, ["sample", "block"])
    fact = lambda rows, name: rows.select("sample", "region", "value", F.lit(name).alias("what"))
    facts = fact(used.where("d IS NULL"), "live_in").unionByName(fact(used.where("d"), "internal_uses")).unionByName(fact(used, "raw_uses"))
    facts = facts.unionByName(fact(defined.where("u IS NULL"), "live_out")).unionByName(fact(every, "raw_defs")).distinct()
    names = ["live_in", "live_out", "internal_uses", "raw_defs", "raw_uses"]
    found = facts.groupBy("sample", "region").agg(*(F.array_sort(F.collect_list(F.when(F.col("what") == n, F.col("value")))).alias(n) for n in names))
    out = regions.select("sample", "region").distinct().join(found, ["sample", "region"], "left")
    none = F.array().cast(f"array<{dict(accesses.dtypes)['value']}>")
    out = out.withColumns({n: F.coalesce(n, none) for n in names}).withColumn("internal_defs", F.array_except("raw_defs", "live_out"))
    return out.select("sample", "region", "live_in", "live_out", "internal_defs", "internal_uses", "raw_defs", "raw_uses")


# What names a memory operand, which instructions read and write memory, how a written operand stands, and names of a returned value.
MEMORY, READS, WRITES, WRITTEN = r"\[|\]| ptr |rip", ["mov", "cmp", "test", "lea", "push"], ["mov", "stos", "xchg", "cmpxchg"], r"\[[^\]]+\]\s*,"
RETURNED = r"(?i)^(?:r?ax|e?ax|ax|al|ret(?:urn)?(?:_value)?)(?:[@_.#-]?\d+)?$"


def _any(column: Column, prefixes: list[str]) -> Column:
    return column.rlike("^(?:" + "|".join(prefixes) + ")")


def region_effects(instructions: DataFrame, regions: DataFrame) -> DataFrame:
    """Per (sample, region), from instructions (sample, block, ordinal, text): read_set and write_set (texts that read and write memory), calls (places in order), volatile (places), and n_instructions."""
    regions = _plain(regions, "sample", "region", "block")
    text = F.lower(F.coalesce("text", F.lit("")))
    op = F.regexp_extract(text, r"^\s*(\S+)", 1)
    memory = text.rlike(MEMORY)
    rows = instructions.withColumns({"_read": memory & _any(op, READS), "_write": memory & _any(op, WRITES) & text.rlike(WRITTEN), "_call": op.startswith("call"), "_volatile": text.contains("volatile")})
    place = F.struct("block", "ordinal")
    texts = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.trim("text"))))
    places = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), place)))
    found = rows.join(regions, ["sample", "block"]).groupBy("sample", "region").agg(texts("_read").alias("read_set"), texts("_write").alias("write_set"), places("_call").alias("calls"), places("_volatile").alias("volatile"), F.count("*").alias("n_instructions"))
    return regions.select("sample", "region").distinct().join(found, ["sample", "region"], "left").na.fill(0, ["n_instructions"])


def fact_state(found: Column, instructions: Column, real: Column, any_source: Column) -> Column:
    """How far a region's facts go: those of a decoded function (`real`) or of a stand-in; an empty set is proven only by a decoded one."""
    return (
        F.when(found, F.when(real, "nonempty_real").otherwise("nonempty_proxy"))
        .when((instructions > 0) & real, "proven_empty_real")
        .when((instructions > 0) & any_source, "empty_proxy_needs_v3")
        .otherwise("not_available")
    )


def returned_value(values: Column) -> Column:
    """The first of some values that is named like a returned one, or null."""
    like = lambda v: v.rlike(RETURNED) | F.split(v, r"[@_.#-]", 2)[0].rlike(RETURNED) | F.lower(v).contains("ret_value")
    return F.get(F.filter(values, like), F.lit(0))

"""MinHash near-duplicates by fast similarity sketching.

A document's set is its distinct 5-word shingles, as 64-bit hashes. The sketch has BINS coordinates: in round i of the first BINS
rounds each shingle is hashed to a bin and a value, in the second BINS rounds all go to bin i - BINS, so every bin is filled after
2 * BINS rounds at the latest; a value carries its round in its top bits, so a bin keeps the smallest value of its first round.
BANDS bands of ROWS bins give candidate pairs; at a similarity of 0.75 a pair shares no band with a chance of about 5e-6.

1. Equal sets collapse to one key (a 128-bit digest of the sorted set behind the smallest id that has it), so copies cost nothing from here on.
2. In each band's bucket every member is compared with the smallest key (a star, not all pairs), on full sets.
3. The links give components. A bucket whose members other than its smallest key still lie in different components is open. All links among the
   members of open buckets are found exactly, by their rare shingles: of n shingles, ordered by how many open members have them, two sets of similarity 0.75 share
   one of the first n - ceil(0.75 n) + 1 of both. So what members have in common as boilerplate pairs nobody; only members of different components that
   share a rare shingle meet. A rare shingle of over BLOCK members is dealt to chunks and each pair of chunks meets once, in a
   group of at most about 2 * BLOCK members. Members carry parity signatures there, of 2 to 4 bits a shingle: as these differ in no more bits than sets differ in shingles, they
   rule out unlike pairs and no other. Of what they let pass, a spanning forest is compared on full sets; only if one of its pairs fails are all that still join different components compared, too.
4. Components by contraction: nodes hook to their smallest neighbour, labels jump, edges between labels are contracted until none is left. As keys
   begin with the smallest id, the label of a component names its component_id.

No bucket or group meets in one task: stars are joins that adaptive execution can split, and the groups of step 3 are bounded. How often a shingle occurs among
open members is counted in COUNTERS counters (4 MB, whatever the input), so the order is the same for all; its quality only decides how much is compared.

Cases: a null or empty text, or one without words, has no set; its component is its own doc_id. A text of fewer than 5 words has its
whole sequence as one shingle. Repeated rows keep their rows and share a component; a null doc_id never becomes a component's id
unless all members have none. Of ties any order gives the same rows. An empty table gives an empty result. Very long texts are hashed in parts. Extra columns
are ignored, but for those named in `carry`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import mix, shingle_hashes, slices, text_bytes, word_hashes
from .shared import removed, small_batches, written

SHINGLE, BINS, ROWS = 5, 128, 4
BANDS = BINS // ROWS
NUMERATOR, DENOMINATOR = 75, 100
#: Members of a chunk; two chunks are compared in one group.
BLOCK = 256
#: Counters of shingles: a shingle's frequency is that of its counter.
COUNTERS = 1 << 20
#: Candidate ids up to this number are broadcast (8 bytes each) to pick their texts; beyond it they are joined by a shuffle.
BROADCAST_IDS = 400_000


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, doc = shingle_hashes(*word_hashes(*text_bytes(column)), SHINGLE)
    ends = np.searchsorted(doc, np.arange(len(column) + 1))
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        s = np.sort(h[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a else s)
    return out


def key_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of `bins` filled coordinates for each set that isn't empty."""
    n = len(sets)
    out = np.full(n * bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    values, base = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(n) * bins, [len(s) for s in sets])
    for i in range(2 * bins):
        if not len(values):
            break
        h = mix(values + np.uint64(0xD1B54A32D192ED03 * (i + 1) % 2**64))
        to = base + ((h & np.uint64(bins - 1)).astype(np.int64) if i < bins else i - bins)
        np.minimum.at(out, to, (h >> np.uint64(8)) | (np.uint64(i) << np.uint64(56)))
        if i % 3 == 0 or len(values) < 100_000:
            open_ = (out.reshape(n, bins) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)[base // bins]
            values, base = values[open_], base[open_]
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), -1, ROWS)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = sets_of(part["text"])
            bands = band_keys(sketches(sets))
            full = np.array([len(s) > 0 for s in sets])
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            names = [c for c in part.schema.names if c != "text"]
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([key_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].ravel()))]
            yield pa.record_batch([*(part[c] for c in names), *own], [*names, "n", "digest", "bands"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = sets_of(part["text"])
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch({"digest": pa.array([key_of(s) for s in sets], pa.binary()), "s": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})


def signature(s: np.ndarray) -> bytes:
    """A bit for each place: how many shingles fall there, odd or even. A power of two of places, 2 for each shingle at least."""
    places = max(256, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s.view(np.uint64)) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, one: int, m: int, other: int) -> bool:
    """Whether sets of n and m shingles with these signatures (as integers) can be similar enough: they differ in (1 - t) / (1 + t) of n + m shingles at most."""
    if DENOMINATOR * min(n, m) < NUMERATOR * max(n, m):
        return False
    p, q = (max(256, 1 << (2 * k - 1).bit_length()) for k in (n, m))
    while p != q:  # places that are equal modulo half of them fall together
        if p > q:
            one, p = (one ^ (one >> (p // 2))) & ((1 << (p // 2)) - 1), p // 2
        else:
            other, q = (other ^ (other >> (q // 2))) & ((1 << (q // 2)) - 1), q // 2
    return (DENOMINATOR + NUMERATOR) * (one ^ other).bit_count() <= (DENOMINATOR - NUMERATOR) * (n + m)


def pairs_within(members: list[tuple[bytes, bytes, int, int, int]], forest: bool) -> list[tuple[bytes, bytes]]:
    """Pairs of members (key, comp, side, n, signature) of different components that may be links, those of side 0 with those of side 1, or if all are of side 0, among
    each other. With `forest` only as many as join what they all would join."""
    root = {x[1]: x[1] for x in members}

    def top(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    left = [x for x in members if not x[2]]
    right = [x for x in members if x[2]]
    out = []
    for k, (u, c, _, n, one) in enumerate(left):
        for v, d, _, m, other in right or left[k + 1 :]:
            if c != d and not (forest and top(c) == top(d)) and may_link(n, one, m, other):
                out.append((u, v))
                root[top(c)] = top(d)
    return out


def prefix_length(n: int) -> int:
    """Of n ordered shingles, how many one must look at to meet one of any set that is similar enough."""
    return n + 1 - -(-NUMERATOR * n // DENOMINATOR)


def _counter(s: np.ndarray) -> np.ndarray:
    return (mix(s.view(np.uint64)) >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(_counter(batch["s"].flatten().to_numpy()), minlength=COUNTERS)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["counter", "n"])


def _prefixed(counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s in batch["s"]:
                s = np.asarray(s.values)
                often = counts[_counter(s)]
                first = np.lexsort((s, often))[: prefix_length(len(s))]
                found.append(s[first[often[first] > 1]])  # what one member alone has meets nobody
            k = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.record_batch([pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), batch["key"].take(k), batch["comp"].take(k)], ["shingle", "key", "comp"])

    return prefixes


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.asarray(s.values) for s in batch["s"]]
        yield pa.record_batch([batch["key"], pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary())], ["key", "n", "bits"])


def _group_pairs(forest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run of equal (shingle, i, j); rows come sorted by these."""
        held: list[tuple[bytes, bytes, int, int, int]] = []
        found: list[tuple[bytes, bytes]] = []

        def taken() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["u", "v"])
            found.clear()
            return out

        last = None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("shingle", "i", "j", "key", "comp", "side", "n", "bits")), strict=True):
                if row[:3] != last:
                    found += pairs_within(held, forest)
                    last, held = row[:3], []
                held.append((*row[3:7], int.from_bytes(row[7], "little")))
            yield taken()
        found += pairs_within(held, forest)
        yield taken()

    return pairs


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a = pairs.join(sets.select(F.col("key").alias("v"), F.col("s").alias("sv")), "v").join(sets.select(F.col("key").alias("u"), F.col("s").alias("su")), "u")
    a = a.where(f"{DENOMINATOR} * least(size(su), size(sv)) >= {NUMERATOR} * greatest(size(su), size(sv))")
    both = "size(array_intersect(su, sv))"
    return a.where(f"{DENOMINATOR} * {both} >= {NUMERATOR} * (size(su) + size(sv) - {both})").select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """(key, comp) of every key in links (u, v), comp the smallest key that it reaches."""
    edges = written(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    label = written(edges.select(F.explode(F.array("u", "v")).alias("key")).distinct().withColumn("comp", F.col("key")), "labels")
    while edges.count():
        both = edges.union(edges.select("v", "u"))
        hooked = written(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "hooked")
        jump = hooked.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = written(hooked.join(jump, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "parents")
        moved = written(label.join(parent.withColumnRenamed("u", "comp"), "comp", "left").select("key", F.coalesce("p", "comp").alias("comp")), "labels")
        left = edges.join(parent.select("u", F.col("p").alias("pu")), "u").join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        left = written(left.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        removed(hooked, parent, label, edges)
        label, edges = moved, left
    removed(edges)
    return label


def candidate_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, s) for each of keys (key, rep, digest), from the texts whose ids are rep."""
    ids = keys.select(F.col("rep").alias("_id")).distinct()
    n = ids.count()
    texts = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select("text")
    found = texts.mapInArrow(_with_sets, "digest binary, s array<bigint>").where("digest IS NOT NULL")
    return found.join(keys.select("digest", "key"), "digest").groupBy("key").agg(F.first("s").alias("s"))


#: A key sorts by the id that it begins with, nulls last, and that id can be read from it.
_KEY = "concat(unhex(CASE WHEN rep IS NULL THEN '01' ELSE '00' END), unhex(lpad(hex(coalesce(rep, 0L) ^ CAST('-9223372036854775808' AS BIGINT)), 16, '0')), digest)"
_ID = "CASE WHEN hex(substring({0}, 1, 1)) = '00' THEN CAST(conv(hex(substring({0}, 2, 8)), 16, -10) AS BIGINT) ^ CAST('-9223372036854775808' AS BIGINT) END"


def open_members(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, comp) of the members, but for the leaders, of buckets that hold several components."""
    placed = members.where("key <> leader").select("band", "key").join(comp, "key", "left").select("band", "key", F.coalesce("comp", "key").alias("comp"))
    placed = written(placed, "placed")
    wide = written(placed.groupBy("band").agg((F.min("comp") != F.max("comp")).alias("open")).where("open").select("band"), "wide")
    found = written(placed.join(wide, "band").select("key", "comp").distinct(), "open")
    removed(placed, wide)
    return found


def chunk_pairs(shingles: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shingle, i, j, side, key, comp): groups of two chunks at most, of about `block` members each, in which any two members of different components that share a shingle
    meet once, on different sides (or both on side 0 where i = j).

    The members of a shingle's largest component need not meet each other: their chunks only meet those of the other members. Of shingles with the
    same members, as those of a shared passage have, one stays.
    """
    per = shingles.groupBy("shingle", "comp").agg(F.count("*").alias("c"), F.expr("sum(CAST(xxhash64(key) AS DECIMAL(20,0)))").alias("sign"))
    whole = per.groupBy("shingle").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"), F.sum("sign").alias("sign")).where("k > 1")
    once = whole.groupBy("sign", "m").agg(F.min_by(F.struct("shingle", "main", "most"), "shingle").alias("x"))
    size = lambda c: F.ceil(c / block).cast("int")
    once = written(once.select("x.shingle", "x.main", size(F.col("m") - F.col("x.most")).alias("others"), size(F.col("x.most")).alias("mains")), "postings")
    work = shingles.join(once, "shingle").withColumns({"_main": F.col("comp") == F.col("main"), "_h": F.xxhash64("key")})
    own = F.when(F.col("_main"), F.col("others") + F.pmod(F.col("_h"), F.col("mains"))).otherwise(F.pmod(F.col("_h"), F.col("others"))).cast("int")
    work = work.withColumn("own", own).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(F.col("_main"), 0).otherwise(F.col("mains")))))
    work = work.withColumns({"i": F.least("own", "d"), "j": F.greatest("own", "d")})
    return work.select("shingle", "i", "j", (F.col("own") != F.col("i")).cast("int").alias("side"), "key", "comp")


def rare_links(opened: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame | None:
    """links and those among opened (key, comp) that join different components, by their rare shingles; None if there are no more."""
    whole = written(opened.join(sets, "key"), "open-sets")
    counted = whole.select("s").mapInArrow(_counted, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # COUNTERS rows at most
    counts = np.ones(COUNTERS, np.int32)
    counts[counted["counter"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**31 - 1)
    shingles = written(whole.mapInArrow(_prefixed(counts), "shingle bigint, key binary, comp binary"), "prefixes")
    signed = written(whole.select("key", "s").mapInArrow(_signed, "key binary, n bigint, bits binary"), "signatures")
    pairs = written(chunk_pairs(shingles), "chunks")

    def found(comp: DataFrame | None, forest: bool) -> tuple[DataFrame, DataFrame]:
        here = pairs if comp is None else pairs.drop("comp").join(comp, "key")
        work = here.join(signed, "key").repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
        may = written(work.mapInArrow(_group_pairs(forest), "u binary, v binary").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "may")
        return may, written(verified(may, sets), "more")

    may, more = found(None, True)
    if may.isEmpty():
        removed(whole, shingles, signed, pairs)
        return None
    links = links.union(more)
    if may.count() > more.count():  # else the forest joins all that may be links
        joined = components(links)
        now = opened.select("key", "comp").join(joined.withColumnRenamed("comp", "now"), "key", "left").select("key", F.coalesce("now", "comp").alias("comp"))
        links = links.union(found(now, False)[1])
    removed(whole, shingles, signed, pairs)
    return links


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the columns of `carry`, doc_id, n_shingles, component_id, kept, and group_key (equal for all rows of a component; null without a set)."""
    small_batches(docs.sparkSession)
    docs = docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    for name, kind in (("n", T.LongType()), ("digest", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)
    rows = written(docs.mapInArrow(_sketched, schema), "sketches")
    reps = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = written(reps.withColumn("key", F.expr(_KEY)), "reps")
    banded = reps.select("key", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.min("key").alias("leader"), F.max("key").alias("other")).where("leader <> other").select("band", "leader")
    crowded = written(crowded, "crowded")
    members = written(banded.join(crowded, "band"), "members")
    stars = written(members.where("key <> leader").select(F.col("leader").alias("u"), F.col("key").alias("v")).distinct(), "stars")
    keys = written(reps.select("key", "rep", "digest").join(stars.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "key", "left_semi"), "keys")
    sets = written(candidate_sets(docs, keys), "sets")
    links = written(verified(stars, sets), "links")
    comp = components(links)
    opened = open_members(members, comp)
    more = rare_links(opened, sets, links)
    final = comp if more is None else components(more)
    removed(crowded, members, stars, keys, sets, opened)
    named = reps.select("digest", "key").join(final, "key", "left").select("digest", F.coalesce("comp", "key").alias("group_key"))
    out = rows.join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.expr(_ID.format("group_key")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull())
    return out.withColumn("component_id", component).select(*carry, "doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "group_key")

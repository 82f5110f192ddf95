"""Slot matching by hand-worked cases."""

import pytest

from loomspark.operators import contracts as C

SCHEMA = "f int, side string, sid bigint, kind string, primary array<bigint>, context array<bigint>"


def matched(spark, predicted, wanted, threshold, gap):
    """Matches, what is left of both sides, and what is ambiguous, of one function."""
    rows = [(1, side, *s) for side, slots in (("p", predicted), ("w", wanted)) for s in slots]
    matches, left = C.matched_slots(spark.createDataFrame(rows, SCHEMA), "f", threshold, gap)
    left = left.collect()
    of = lambda side: sorted(r.sid for r in left if r.side == side and r.left)
    return sorted(tuple(r)[1:] for r in matches.collect()), of("p"), of("w"), sorted(r.sid for r in left if r.ambiguous)


def test_slots_match_by_order_then_overlap(spark):
    predicted = [(0, "ROOT", [], []), (1, "COND", [], []), (2, "BLOCK", [1, 2], []), (3, "BLOCK", [9], [8]), (4, "BRANCH", [], None), (5, "COND", [7], [])]
    wanted = [(1, "COND", [4], []), (2, "BLOCK", [1, 2, 3], []), (3, "BLOCK", [1, 2, 2], []), (4, "BLOCK", [8], [7])]
    found, left, open_, unsure = matched(spark, predicted, wanted, 0.6, 0.4)
    assert found == [(1, 1, 1.0, "cond_order"), (2, 3, 1.0, "bb_overlap")]
    assert left == [3, 5] and open_ == [2, 4] and unsure == [2]  # the second best of 2 has two thirds
    assert matched(spark, predicted, wanted, 0.6, 0.1)[3] == []


def test_contexts_count_half_beside_primary_blocks(spark):
    one = [(1, "BLOCK", [1], [5, 6])]
    assert matched(spark, one, [(2, "BLOCK", [2], [5, 6])], 0.5, 0.1)[0] == [(1, 2, 0.5, "bb_overlap")]
    assert matched(spark, [(1, "BLOCK", [], [5, 6])], [(2, "BLOCK", [], [5, 6])], 0.9, 0.1)[0] == [(1, 2, 1.0, "bb_overlap")]
    assert matched(spark, [(1, "BLOCK", [], [])], [(2, "BLOCK", None, [])], 0.9, 0.1)[0] == [(1, 2, 1.0, "bb_overlap")]
    assert matched(spark, [(1, "BLOCK", [0], [])], [(2, "BLOCK", [], [])], 0.6, 0.1)[0] == []
    assert matched(spark, one, [(2, "CASE", [1], [5, 6])], 0.1, 0.1)[0] == []
    with pytest.raises(ValueError):
        matched(spark, one, one, 0.0, 0.1)


def test_offers_of_one_wanted_slot_go_to_the_best(spark):
    predicted = [(1, "BLOCK", [1], []), (2, "BLOCK", [1, 2], [])]
    assert matched(spark, predicted, [(9, "BLOCK", [1, 2], [])], 0.3, 0.0)[:2] == ([(2, 9, 1.0, "bb_overlap")], [1])


def by_hand(slots, threshold, gap):
    """Matches and (side, sid, left, ambiguous) of what is left, of one function's slots (side, sid, kind, primary, context)."""
    slots = [(s, i, k, set(a or ()) - {None}, set(b or ()) - {None}) for s, i, k, a, b in slots]
    slots = sorted((x for x in slots if x[1] != 0 and not (x[0] == "p" and x[2] == "BRANCH" and not x[3] | x[4])), key=lambda x: x[1])
    ordered = list(zip(*([x[1] for x in slots if x[0] == side and x[2] == "COND"] for side in "pw"), strict=False))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    slots = [x for x in slots if x[1] not in [o["pw".index(x[0])] for o in ordered]]
    offers, unsure = {}, set()
    for p in (x for x in slots if x[0] == "p"):
        scores = []
        for w in (x for x in slots if x[0] == "w" and x[2] == p[2]):
            near = jaccard(p[4], w[4])
            scores.append((max(jaccard(p[3], w[3]), 0.5 * near) if p[3] | w[3] else near, w[1]))
        best = sorted((x for x in scores if x[0] >= threshold), reverse=True)
        if best:
            offers.setdefault(best[0][1], []).append((best[0][0], p[1]))
        if len(best) > 1 and best[0][0] - best[1][0] < gap:
            unsure.add(p[1])
    overlap = [(max(o)[1], w, round(max(o)[0], 4), "bb_overlap") for w, o in offers.items()]
    gone = {("p", m[0]) for m in overlap} | {("w", m[1]) for m in overlap}
    left = [(s, i, (s, i) not in gone, s == "p" and i in unsure) for s, i, *_ in slots]
    return {(p, w, 1.0, "cond_order") for p, w in ordered} | set(overlap), {x for x in left if x[2] or x[3]}


def test_functions_as_rows_and_in_joins_match_alike(spark, monkeypatch):
    """Functions of up to the bound in one row each, larger ones in joins, against brute force; slots of no function match nothing, blocks without a number do not count."""
    import random

    rng = random.Random(3)
    blocks = lambda: rng.choice([None, [], [rng.randrange(6) for _ in range(rng.randint(1, 4))], [rng.randrange(4), None]])
    slots = {f: [(rng.choice("pw"), k, rng.choice(["COND", "BLOCK", "BRANCH", "CASE"]), blocks(), blocks()) for k in range(rng.randint(1, 14))] for f in range(60)}
    loose = [(None, side, k, "COND", [1], [1]) for side in "pw" for k in (1, 2)]
    frame = spark.createDataFrame([(f, *s) for f, own in slots.items() for s in own] + loose, "f int, side string, sid bigint, kind string, primary array<bigint>, context array<bigint>")
    want = {f: by_hand(own, 0.4, 0.2) for f, own in slots.items()}
    audits = []
    for bound in (0, 8, 256):
        monkeypatch.setattr(C, "WHOLE", bound, raising=False)
        matches, left = C.matched_slots(frame, "f", 0.4, 0.2)
        assert {tuple(r) for r in matches.collect()} == {(f, *m) for f, x in want.items() for m in x[0]}
        assert {tuple(r) for r in left.collect() if r.f is not None} == {(f, *m) for f, x in want.items() for m in x[1]}
        audits.append({tuple(r) for r in C.slot_audit(frame, "f", 0.4, 0.2).collect()})
    assert audits[0] == audits[1] == audits[2] and len(audits[0]) == 61

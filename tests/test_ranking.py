"""Compaction and pair choice against their plain statements."""

import random
from collections import Counter

from loomspark.operators import ranking as R
from loomspark.operators import sampling as S


def _plain(rows, total, family_cap, signature_cap, mixed_cap):
    """Step by step, as the rule is told."""
    kept = [r["id"] for r in rows if r["name"] in R.CORE]
    by = {r["id"]: r for r in rows}
    if total and len(kept) > total:
        full = [i for i in kept if by[i]["name"] == "full_fallback"][:1]
        linear = [i for i in kept if by[i]["name"] == "linear_goto"][: max(0, total - len(full))]
        rest = sorted((i for i in kept if i not in full + linear), key=lambda i: by[i]["score"], reverse=True)
        kept = full + linear + rest[: max(0, total - len(full + linear))]
    for r in sorted(rows, key=lambda r: r["score"], reverse=True):
        families, signatures = Counter(by[i]["family"] for i in kept), Counter(by[i]["signature"] for i in kept)
        if total and len(kept) >= total:
            break
        if r["id"] in kept:
            continue
        if family_cap and families[r["family"]] >= family_cap or signature_cap and signatures[r["signature"]] >= signature_cap:
            continue
        if mixed_cap and r["family"] == "mixed_if_policy" and families["mixed_if_policy"] >= mixed_cap:
            continue
        kept.append(r["id"])
    return sorted(kept)


def test_compaction():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 40)
        rows = [{"id": k, "name": rng.choice([*R.CORE, *"abcdefghijkl"]), "family": rng.choice(["mixed_if_policy", "x", "y"]), "signature": rng.choice("pqrs"), "score": (rng.randint(0, 5), -k)} for k in range(n)]
        caps = [rng.choice([0, 1, 2, 5, 12]) for _ in range(4)]
        assert R.compacted_ids(rows, *caps) == (_plain(rows, *caps) if any(caps) else list(range(n)))


def test_spread_places():
    for n in range(12):
        for k in range(14):
            found = S.spread_places(n, k)
            plain = [] if not n or not k else list(range(n)) if n <= k else [n // 2] if k == 1 else sorted({int((n - 1) * i / (k - 1)) for i in range(k)})
            assert found == plain


def test_places_do_not_depend_on_the_branch(spark):
    df = spark.range(2000).selectExpr("(id * 7919) % 2003 AS k").repartition(7)
    rows = sorted((r["_place"], r["k"]) for r in S.placed(df, "k").collect())
    assert [p for p, _ in rows] == list(range(2000)) and [k for _, k in rows] == sorted(k for _, k in rows)

import random

from loomspark.functions.placeholders import rename
from loomspark.operators import labels as L


def by_hand(roles, stmt, ast, edges):
    """The rule block by block, in order."""
    out = list(roles)
    n = len(roles)
    into = {b: [s for s, d, _ in edges if d == b] for b in range(n)}
    onto = {b: [d for s, d, _ in edges if s == b] for b in range(n)}
    branching = {s for s, _, t in edges if t == 0}
    for b in range(n):
        if stmt[b] is None or out[b] != 0:
            continue
        t = ast[b]
        if t == 2:
            if b in branching:
                out[b] = 1
            elif len(into[b]) == 1 and into[b][0] in branching and stmt[into[b][0]] == stmt[b]:
                out[b] = 2
        elif t in (3, 4, 5):
            out[b] = 4
        elif t == 6:
            out[b] = 7
        elif t == 7:
            out[b] = 8
        elif t in (8, 9, 10, 11) and not onto[b]:
            out[b] = 9
    for b in range(n):
        if out[b] != 1 or stmt[b] is None or ast[b] != 2:
            continue
        for c in onto[b]:
            if out[c] != 0 or stmt[c] is None:
                continue
            if stmt[c] == stmt[b]:
                out[c] = 2
            elif len(into[c]) == 1:
                out[c] = 2 if ast[c] in (8, 9, 10, 11) and len(onto[c]) == 1 and not onto[onto[c][0]] else 3
    return out


def test_refinement_on_random_graphs(spark):
    rng = random.Random(11)
    blocks, edges, expected = [], [], {}
    for g in range(150):
        n = rng.randint(1, 9)
        kinds = [rng.choice([0, 2, 2, 2, 3, 6, 7, 8, 9, 15]) for _ in range(n)]
        stmt = [rng.choice([None, *range(4)]) for _ in range(n)]
        ast = [None if s is None else kinds[s % n] for s in stmt]
        roles = [rng.choice([0, 0, 0, 0, 5, 1]) for _ in range(n)]
        e = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))})
        e = [(a, b, rng.choice([0, 0, 1, 2])) for a, b in e]
        blocks += [(g, b, roles[b], stmt[b], ast[b]) for b in range(n)]
        edges += [(g, *x) for x in e]
        expected |= {(g, b): r for b, r in enumerate(by_hand(roles, stmt, ast, e))}
    df = L.refined(spark.createDataFrame(blocks, "sample int, b int, role int, s int, ast int"), spark.createDataFrame(edges, "sample int, src int, dst int, etype int"))
    assert {(r.sample, r.b): r.refined for r in df.collect()} == expected


def test_placeholders():
    assert rename(["int x = foo (a, b);", "return x + foo(c);", None]) == ["int var_0 = func_0 (var_1, var_2);", "return var_0 + func_0(var_3);", ""]


def test_blocks_meet_their_statements_once(spark):
    """Penalties by hand, also of types and roles that there are not; one aggregate of blocks and one join, whatever the number of roles and types."""
    shares = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 4, 1.0), (1, 2, None, 1.0), (2, 0, 99, 1.0), (3, 0, 0, 1.0)], "sample int, b int, role int, p double")
    statements = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 4), (1, 3, None), (1, 4, 99), (2, 0, 0)], "sample int, s int, ast int")
    found = L.type_penalty(shares, statements, spark, ["sample"])
    want = {(1, 0, 0): 0.5, (1, 0, 1): 0.5, (1, 1, 2): 0.0}
    assert {(r.sample, r.b, r.s): r.penalty for r in found.collect()} == {(1, b, s): want.get((1, b, s), 1.0) for b in range(3) for s in range(5)} | {(2, 0, 0): 1.0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 1

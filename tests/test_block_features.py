"""The twelve features of a block against a literal version on small graphs."""

import random
from math import log2

import pytest

from loomspark.operators import graph as G
from loomspark.plans import queries


def literal(n, edges, facts, back):
    def depths(root, edges):
        nexts = {k: [b for a, b in edges if a == k] for k in range(n)}
        live = G.reachable([root], nexts)
        above = {k: {a for a in live if a != k and k not in G.reachable([root], nexts, without=a)} for k in live}
        return [float(len(above[k])) if k in live else 1.0 for k in range(n)], above

    def places(order):
        order = order + [k for k in range(n) if k not in order]
        return [order.index(k) / max(n - 1, 1) for k in range(n)]

    succ = {k: [b for a, b in edges if a == k] for k in range(n)}
    dom, above = depths(0, edges)
    ends = [k for k in range(n) if not succ[k]]
    post, _ = depths(ends[0] if ends else n - 1, [(b, a) for a, b in edges])
    headers = {b for a, b in edges if a == b or b in above.get(a, ())}
    exits = {a for a, b in edges if b in headers and (a, b) in back} | {k for k in facts if edges and facts[k][4]}
    dfs, stack = [], [0]
    while stack:
        k = stack.pop()
        if k not in dfs:
            dfs.append(k)
            stack += reversed(succ[k])
    bfs, at = [0], 0
    while at < len(bfs):
        bfs += [m for m in dict.fromkeys(succ[bfs[at]]) if m not in bfs]
        at += 1
    deep, wide = places(dfs), places(bfs)
    if not edges:
        dom = post = [0.0] * n
    return {k: [float(sum(b == k for _, b in edges)), float(len(succ[k])), float(k in headers), float(k in exits), dom[k], post[k], facts[k][0] / 64, facts[k][1], float(facts[k][2]), float(facts[k][3]), deep[k], wide[k]] for k in range(n)}


def test_against_a_literal_version():
    assert G.FEATURES == "in_degree out_degree is_loop_header is_loop_exit dom_depth post_dom_depth size entropy has_call has_indirect_jump dfs_place bfs_place".split()
    rng = random.Random(5)
    for _ in range(800):
        n = rng.randint(1, 9)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]  # in any order, some twice
        facts = {k: (rng.randint(0, 200), rng.random(), rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.1) for k in range(n)}
        back = {e for e in edges if rng.random() < 0.5}
        assert G.block_features(0, list(range(n)), edges, facts, back) == literal(n, edges, facts, back)
    assert G.block_features(0, [0, 1], [(0, 1), (1, 0)])[1][:4] == [1.0, 1.0, 0.0, 1.0]  # by default a back edge is one to no larger number


def test_facts_of_blocks(spark):
    rows = [(1, 0, "mov", False, False)] * 2 + [(1, 0, "call", True, False), (1, 0, "jmp", False, True), (1, 2, "mov", False, False), (2, 0, "call", True, False)]
    out = {(r.sample, f.node): tuple(f)[1:] for r in G.block_facts(spark.createDataFrame(rows, "sample bigint, node bigint, opcode string, is_call boolean, is_indirect_jump boolean")).collect() for f in r.facts}
    assert out == {(1, 0): (4, pytest.approx(1.5), True, True, False), (1, 2): (1, 0.0, False, False, False), (2, 0): (1, 0.0, True, False, False)}


def test_query_takes_the_facts(spark):
    d = "/root/testdata/sf0.001"
    out = queries()["block_features"](spark, d)
    total = out.selectExpr("sum(size) * 64 AS n", "max(entropy) AS h", "max(has_call) AS c", "max(has_indirect_jump) AS j").first()
    assert round(total.n) == spark.read.parquet(f"{d}/events.parquet").count() and 0 < total.h <= log2(7) and total.c == total.j == 1

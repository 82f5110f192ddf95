import itertools
import random

import numpy as np

from loomspark.operators import graph as G
from loomspark.operators import transport as O
from loomspark.streaming.curriculum import Rules, State

GRAPHS = {
    "single": (1, []),
    "linear4": (4, [(0, 1), (1, 2), (2, 3)]),
    "if_else": (4, [(0, 1), (0, 2), (1, 3), (2, 3)]),
    "while_exit": (3, [(0, 1), (0, 2), (1, 0)]),
    "loop_continue_break": (5, [(0, 1), (1, 2), (1, 4), (2, 1), (2, 3), (3, 1)]),
    "cross_edge": (5, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (1, 4)]),
    "irreducible_like": (4, [(0, 1), (0, 2), (1, 2), (2, 1), (2, 3)]),
}


def graph(name):
    n, edges = GRAPHS[name]
    nodes = list(range(n))
    return nodes, edges, *G.adjacency(nodes, edges)


def test_known_dominators_and_loops():
    idom = {k: G.immediate_dominators(0, *graph(k)[2:]) for k in GRAPHS}
    assert idom["linear4"] == {1: 0, 2: 1, 3: 2} and idom["if_else"][3] == 0 and idom["cross_edge"] == {1: 0, 2: 0, 3: 0, 4: 0}
    assert idom["irreducible_like"][3] == 2
    loops = {k: G.loops(0, *graph(k)[:2]) for k in GRAPHS}
    assert loops["while_exit"] == {0: {0, 1}} and loops["loop_continue_break"] == {1: {1, 2, 3}}
    assert not loops["irreducible_like"] and not loops["linear4"] and not loops["single"]
    assert G.irreducible(0, *graph("irreducible_like")[:2]) == [[1, 2]] and G.irreducible(0, *graph("while_exit")[:2]) == []


def test_kernels_on_random_graphs():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        nodes = list(range(n))
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))})
        out, into = G.adjacency(nodes, edges)
        live, idom = G.reachable([0], out), G.immediate_dominators(0, out, into)
        for a in live:
            for b in live:
                assert G.dominates(idom, a, b) == (a == b or b not in G.reachable([0], out, without=a))
        reach = {a: G.reachable([a], out) for a in nodes}
        assert G.strong_components(nodes, out) == sorted({tuple(sorted(b for b in nodes if b in reach[a] and a in reach[b])) for a in nodes} and [list(x) for x in {tuple(sorted(b for b in nodes if b in reach[a] and a in reach[b])) for a in nodes}])
        post = G.post_dominators(nodes, out, into)
        ends = {m for m in nodes if not out[m]}
        for a in nodes:
            if not (reach[a] & ends):
                assert a not in post
                continue
            for b in nodes:
                cut = not (G.reachable([a], out, without=b) & ends) if b != a else True
                chain, x = {a}, a
                while x in post:
                    x = post[x]
                    chain.add(x)
                assert (b in chain) == cut
        dfs, bfs, depth = G.traversal(0, nodes, out)
        assert set(depth) == live and sorted(dfs.values()) == sorted(bfs.values()) == list(range(len(nodes)))
        late = [n for n in nodes if n not in live]
        assert [dfs[n] for n in late] == [bfs[n] for n in late] == list(range(len(live), len(nodes)))  # not reached: last, by number
        assert all(depth[b] <= depth[a] + 1 for a, b in edges if a in live)
        features = G.block_features(0, nodes, edges)
        assert all(len(f) == len(G.FEATURES) for f in features.values()) and set(features) == set(nodes)
        for region in G.single_entry_exit(0, nodes, edges):
            inner = set(region)
            assert len({b for a, b in edges if b in inner and a not in inner and a in live} | ({0} & inner)) <= 1


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3), (6, 6)):
        for _ in range(20):
            c = rng.integers(0, 9, (n, m)).astype(float)
            pairs = O.hungarian(c)
            assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
            best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
            assert sum(c[i, j] for i, j in pairs) == best


def test_transport_plans():
    rng = np.random.default_rng(1)
    c = rng.random((5, 7))
    p = O.sinkhorn(c, rounds=200)
    assert np.allclose(p.sum(0), 1 / 7) and np.allclose(p.sum(1), 1 / 5, atol=1e-4) and (p >= 0).all()
    for scale, share in ((0.2, 0.2 * 5 / 7), (9.0, 0.45)):
        s = O.with_sink(1 - c, scale, rounds=200)
        assert s.shape == (5, 8) and abs(s[:, -1].sum() - share) < 1e-6 and np.allclose(s[:, :-1].sum(0), (1 - share) / 7)
    assert np.allclose(O.with_sink(1 - c, 0.0), O.sinkhorn(c))
    q = O.structured_sinkhorn(c, np.eye(5, k=1), np.eye(7, k=1))
    assert q.shape == (5, 7) and np.isfinite(q).all()
    assert O.greedy(np.array([[0.9, 0.8], [0.9, 0.1]]), 0.2) == [(0, 0)] and O.greedy(np.array([[0.9, 0.8], [0.7, 0.1]])) == [(0, 0), (1, 1)]


def test_curriculum_rules():
    rules, s = Rules(2, 4, 2, 0.1, 1), State()
    assert [s.step(x, rules) for x in (1.0, 0.95, 0.94)] == ["stay", "stay", "advance:patience"]
    assert [s.step(x, rules) for x in (9, 8, 7, 6, 5)] == ["stay", "stay", "stay", "stop:max_epochs", "over"]


def test_post_dominators_of_several_exits():
    nodes, edges = [0, 1, 2], [(0, 1), (0, 2)]
    assert G.post_dominators(nodes, *G.adjacency(nodes, edges), "all") == {}
    assert G.post_dominators(nodes, *G.adjacency(nodes, edges), "first") == {0: 1}  # the exit with the smallest number alone counts


def test_trees():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3):
        for _ in range(20):
            s, r = rng.normal(size=(n, n)), rng.normal(size=n)
            trees = [t for t in itertools.product(range(n + 1), repeat=n) if all(p != c for c, p in enumerate(t)) and not _cyclic(t, n)]
            total = sum(np.exp(sum(r[c] if p == n else s[c, p] for c, p in enumerate(t))) for t in trees)
            t = O.parent_tree(s, r)
            assert tuple(t) in trees
            share = np.exp(sum(r[c] if p == n else s[c, p] for c, p in enumerate(t))) / total
            assert abs(O.tree_loss(s, r, t) + np.log(share)) < 1e-6
    assert O.parent_tree(np.zeros((0, 0)), np.zeros(0)) == []


def _cyclic(tree, n):
    for c in range(n):
        seen = set()
        while c != n and c not in seen:
            seen.add(c)
            c = tree[c]
        if c != n:
            return True
    return False


def test_structural_regions():
    nodes, edges = list(range(8)), [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 4), (4, 6), (6, 7)]
    found = G.structural_regions(0, nodes, edges, {0: 1, 1: 2, 2: 3, 3: 0, 4: 4, 5: 5, 6: 0, 7: 0})
    assert found == [(1, 0, [0, 1, 2]), (0, None, [3]), (4, 4, [4, 5]), (0, None, [6, 7])]  # only ifs, loops and switches have a header
    assert G.compound_regions([0, 1, 2, 3], [(0, 1), (2, 3)], {0: 5, 1: 5, 2: -1, 3: -1}, {0: 12, 1: 0, 2: 1, 3: 1}) == [(12, 0, [0, 1]), (1, 2, [2, 3])]


def test_rounded_places():
    from loomspark.operators.sampling import rounded_places

    assert rounded_places(10, 4) == [0, 3, 6, 9] and rounded_places(3, 9) == [0, 1, 2] and rounded_places(9, 1) == [0] and rounded_places(0, 3) == []
    assert all(len(rounded_places(n, k)) == min(n, k) for n in range(12) for k in range(15))


def brute_regions(entry, nodes, edges, most):
    """The definition on sets: every pair of nodes, with dominance by taking nodes out."""
    out, _ = G.adjacency(nodes, edges)
    live, ends = G.reachable([entry], out), {n for n in nodes if not out[n]}
    dom = {n: {a for a in live if a == n or n not in G.reachable([entry], out, without=a)} if n in live else {n} for n in nodes}
    post = {n: {b for b in nodes if b == n or not G.reachable([n], out, without=b) & ends} if ends else {n} for n in nodes}
    bodies = [set(x) for x in G.loops(entry, nodes, [e for e in edges if e[0] != e[1]]).values()]
    found = []
    for a in nodes:
        for b in sorted(post[a] - {a}):
            inner = {n for n in nodes if a in dom[n] and b in post[n] and n != b}
            into, leaves = {y for x, y in edges if y in inner and x not in inner}, {y for x, y in edges if x in inner and y not in inner}
            back, crossed = any(x in inner and y == a for x, y in edges), any(inner & body and inner & body != body for body in bodies)
            if a in inner and 2 <= len(inner) <= most and not back and into <= {a} and leaves == {b} and not crossed:
                found.append((-len(inner), a, b, sorted(inner)))
    return [r for k, r in enumerate(x[3] for x in sorted(found)) if r not in [x[3] for x in sorted(found)][:k]]


def test_single_entry_exit_finds_every_region():
    arm = [(0, 1), (0, 4), (1, 2), (2, 3), (4, 3)]
    assert [1, 2] in G.single_entry_exit(0, list(range(5)), arm)
    rng, n_found = random.Random(8), 0
    for _ in range(1500):
        n = rng.randint(1, 9)
        nodes = list(range(n))
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, n + 2))}
        edges = sorted(edges | ({(k, k + 1) for k in range(n - 1) if rng.random() < 0.7} if rng.random() < 0.8 else set()))
        for most in (96, 3):
            found = G.single_entry_exit(0, nodes, edges, most)
            assert found == brute_regions(0, nodes, edges, most)
            n_found += len(found)
    assert n_found > 1000


def test_single_entry_exit_of_large_graphs():
    """A chain of 60 diamonds, 181 nodes: the limit is on a region."""
    edges = sorted(e for k in range(0, 180, 3) for e in ((k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3)))
    found = G.single_entry_exit(0, list(range(181)), edges)
    # of each run of 1 to 32 diamonds one region without its last node, and a run's end is the next one's start
    assert len(found) == sum(60 - k + 1 for k in range(1, 33)) and max(map(len, found)) == 96
    assert found == brute_regions(0, list(range(181)), edges, 96)

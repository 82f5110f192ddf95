"""Analytics of small directed graphs (functions' control flow), one row per graph.

A graph is a row (sample, entry, nodes, edges): sorted node numbers and distinct edges, both bounded by the largest function. Kernels run
over batches of rows in `mapInPandas`, so small graphs don't pay for a task group each. Kernels are iterative: no recursion limit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Edges = list[tuple[int, int]]


def gathered(edges: DataFrame, entries: DataFrame, sample: str = "sample") -> DataFrame:
    """One row per graph out of edge rows (sample, src, dst) and (sample, entry)."""
    e = edges.groupBy(sample).agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    rows = entries.join(e, sample, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<src:bigint,dst:bigint>>")))
    nodes = F.array_sort(F.array_distinct(F.concat(F.array(F.col("entry")), F.col("edges.src"), F.col("edges.dst"))))
    return rows.select(sample, "entry", nodes.alias("nodes"), "edges")


def degrees(edges: DataFrame, sample: str = "sample") -> DataFrame:
    """In- and out-degree over distinct edges."""
    d = edges.select(sample, "src", "dst").distinct()
    ends = d.select(sample, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(d.select(sample, "dst", F.lit(0), F.lit(1)))
    return ends.groupBy(sample, "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def adjacency(nodes: list[int], edges: Edges) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    out, into = {n: [] for n in nodes}, {n: [] for n in nodes}
    for a, b in edges:
        out[a].append(b)
        into[b].append(a)
    return out, into


def reachable(start: list[int], out: dict[int, list[int]], without: int | None = None) -> set[int]:
    seen, todo = set(), [n for n in start if n != without]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [m for m in out[n] if m != without]
    return seen


def immediate_dominators(entry: int, out: dict[int, list[int]], into: dict[int, list[int]]) -> dict[int, int]:
    """Of each reachable node other than the entry, by intersecting chains in reverse postorder until nothing changes."""
    order, seen, todo = [], {entry}, [(entry, iter(out[entry]))]
    while todo:
        n, rest = todo[-1]
        m = next((m for m in rest if m not in seen), None)
        if m is None:
            order.append(n)
            todo.pop()
        else:
            seen.add(m)
            todo.append((m, iter(out[m])))
    place = {n: k for k, n in enumerate(order)}
    idom, changed = {entry: entry}, True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            new = None
            for p in into[n]:
                if p in idom:
                    if new is None:
                        new = p
                    while new != p:
                        while place[new] < place[p]:
                            new = idom[new]
                        while place[p] < place[new]:
                            p = idom[p]
            if new is not None and idom.get(n) != new:
                idom[n], changed = new, True
    idom.pop(entry)
    return idom


def dominates(idom: dict[int, int], a: int, b: int) -> bool:
    while b != a and b in idom:
        b = idom[b]
    return a == b


def post_dominators(nodes: list[int], out: dict[int, list[int]], into: dict[int, list[int]], exits: str = "all") -> dict[int, int]:
    """Immediate post-dominators; `first` takes the first node without successors as the exit, `all` joins all of them in a virtual one (-1)."""
    ends = [n for n in nodes if not out[n]]
    if not ends:
        return {}
    if exits == "first":
        return immediate_dominators(ends[0], into, out)
    up, down = {**into, -1: ends}, {**out}
    for n in ends:
        down[n] = [-1]
    return {n: d for n, d in immediate_dominators(-1, up, {**down, -1: []}).items() if d != -1}


def loops(entry: int, nodes: list[int], edges: Edges) -> dict[int, set[int]]:
    """Natural loops by header: an edge whose target dominates its source closes one; loops of a header are one."""
    out, into = adjacency(nodes, edges)
    idom, live = immediate_dominators(entry, out, into), reachable([entry], out)
    found: dict[int, set[int]] = {}
    for a, b in edges:
        if a in live and dominates(idom, b, a):
            body = found.setdefault(b, {b})
            todo = [a]
            while todo:
                n = todo.pop()
                if n not in body:
                    body.add(n)
                    todo += [p for p in into[n] if p in live]
    return found


def strong_components(nodes: list[int], out: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected components, each sorted, by their smallest node."""
    index, low, stack, on, found, n_seen = {}, {}, [], set(), [], 0
    for root in nodes:
        if root in index:
            continue
        index[root] = low[root] = n_seen
        n_seen += 1
        stack.append(root)
        on.add(root)
        todo = [(root, iter(out[root]))]
        while todo:
            n, rest = todo[-1]
            for m in rest:
                if m not in index:
                    index[m] = low[m] = n_seen
                    n_seen += 1
                    stack.append(m)
                    on.add(m)
                    todo.append((m, iter(out[m])))
                    break
                if m in on:
                    low[n] = min(low[n], index[m])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[n])
                if low[n] == index[n]:
                    part = []
                    while not part or part[-1] != n:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    found.append(sorted(part))
    return sorted(found)


def irreducible(entry: int, nodes: list[int], edges: Edges) -> list[list[int]]:
    """Cycles (components of several nodes) that are entered at more than one node."""
    out, _ = adjacency(nodes, edges)
    found = []
    for part in strong_components(nodes, out):
        inner = set(part)
        doors = {b for a, b in edges if b in inner and a not in inner} | ({entry} & inner)
        if len(part) > 1 and len(doors) > 1:
            found.append(part)
    return found


def label_regions(nodes: list[int], edges: Edges, label: dict[int, int]) -> dict[int, int]:
    """Weakly connected nodes of one label share a region, named by its smallest node."""
    root = {n: n for n in nodes}

    def top(n: int) -> int:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in edges:
        if label[a] == label[b]:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def traversal(entry: int, nodes: list[int], out: dict[int, list[int]]) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
    """Depth-first and breadth-first places of all nodes (neighbours by number; nodes that the entry doesn't reach come last, by number), and the breadth-first depth of reached ones."""
    depth_first, todo = {}, [entry]
    while todo:
        n = todo.pop()
        if n not in depth_first:
            depth_first[n] = len(depth_first)
            todo += sorted(out[n], reverse=True)
    wide, depth, line = {}, {entry: 0}, deque([entry])
    while line:
        n = line.popleft()
        wide[n] = len(wide)
        for m in sorted(out[n]):
            if m not in depth:
                depth[m] = depth[n] + 1
                line.append(m)
    for n in nodes:
        depth_first.setdefault(n, len(depth_first))
        wide.setdefault(n, len(wide))
    return depth_first, wide, depth


def _first_reached(start: int, without: int | None, most: int, out: dict[int, list[int]]) -> set[int]:
    """What start reaches without going through a node; no more than `most` + 1 nodes are looked at."""
    seen, todo = {start}, [start]
    while todo and len(seen) <= most:
        for m in out[todo.pop()]:
            if m != without and m not in seen and len(seen) <= most:
                seen.add(m)
                todo.append(m)
    return seen


def single_entry_exit(entry: int, nodes: list[int], edges: Edges, most: int = 96) -> list[list[int]]:
    """Regions of 2 to `most` nodes that are entered at a node a alone and left to a node b alone, which post-dominates a; no edge leads back to a, and no loop
    is partly inside. Larger ones first, then by a and b. A node from which no exit is reached is post-dominated by all; a graph without exits has no region.

    The nodes are those that a dominates and b post-dominates. If there is a region, they are what a reaches without going through b, which grows with b
    along a's post-dominators; so the walk ends once it has more than `most` nodes. What a dominates and b post-dominates beyond b lies on b's cycles or
    reaches no exit.
    """
    out, into = adjacency(nodes, edges)
    ends = [n for n in nodes if not out[n]]
    live, post, idom = reachable([entry], out), post_dominators(nodes, out, into), immediate_dominators(entry, out, into)
    leaving = reachable(ends, into)
    stuck = live - leaving
    cycle = {n: part for part in strong_components(nodes, out) for n in part}
    bodies = list(loops(entry, nodes, edges).values()) if ends else []
    found: dict[frozenset[int], tuple[int, int]] = {}
    for a in sorted(live) if ends else []:
        exits = []
        if a in leaving:
            b = post.get(a)
            while b is not None:
                exits.append(b)
                b = post.get(b)
        else:
            exits = sorted(_first_reached(a, None, most + 1, out) - {a})  # the exit of a region of `most` nodes is among the first most + 2
        for b in exits:
            inner = frozenset(_first_reached(a, b, most, out))
            if len(inner) > most:
                if a in leaving:
                    break
                continue
            if len(inner) < 2 or any(a in out[n] for n in inner) or not any(b in out[n] for n in inner):
                continue
            if any(n != a and (n == entry or not inner.issuperset(into[n])) for n in inner) or any(inner & body and not inner >= body for body in bodies):
                continue
            if any(m not in inner and m != b and dominates(idom, a, m) and (m in stuck or dominates(post, b, m)) for m in (*cycle[b], *stuck)):
                continue
            found.setdefault(inner, (a, b))
    return [sorted(r) for r, ab in sorted(found.items(), key=lambda x: (-len(x[0]), x[1]))]


#: Roles whose regions have a header: ifs, loops, switches.
HEADED = (1, 4, 7)
Region = tuple[int, "int | None", list[int]]


def back_edge_loops(entry: int, nodes: list[int], edges: Edges) -> list[tuple[int, list[int]]]:
    """(header, nodes) for every edge to another node that dominates its source, in the order of edges: what reaches the source without going through the header."""
    out, into = adjacency(nodes, edges)
    idom, found = immediate_dominators(entry, out, into), []
    for a, b in edges:
        if a != b and dominates(idom, b, a):
            found.append((b, sorted({b} | reachable([a], into, without=b))))
    return found


def _by_label(nodes: list[int], taken: set[int], edges: Edges, label: dict[int, int]) -> list[Region]:
    """Connected nodes of one label among those not taken; the header is the first node where the label has one."""
    rest = [n for n in nodes if n not in taken]
    groups: dict[int, list[int]] = {}
    for n, r in label_regions(rest, [(a, b) for a, b in edges if a not in taken and b not in taken], label).items():
        groups.setdefault(r, []).append(n)
    return [(label[r], r if label[r] in HEADED else None, sorted(ns)) for r, ns in sorted(groups.items())]


def loop_then_label_regions(entry: int, nodes: list[int], edges: Edges, label: dict[int, int], loop_role: int = 4) -> list[Region]:
    """(role, header, nodes) by first node: a region for each back edge, which may overlap, then the label regions of what no loop holds."""
    found: list[Region] = [(loop_role, h, b) for h, b in back_edge_loops(entry, nodes, edges)]
    return sorted(found + _by_label(nodes, {n for _, _, b in found for n in b}, edges, label), key=lambda x: x[2][0])


def until(start: list[int], stop: int | None, out: dict[int, list[int]]) -> set[int]:
    """What start reaches without going through stop; stop itself stays out."""
    return reachable([n for n in start if n != stop], out, without=stop)


def structural_regions(entry: int, nodes: list[int], edges: Edges, role: dict[int, int], loop_role: int = 4, if_role: int = 1, switch_role: int = 7) -> list[Region]:
    """(role, header, nodes) by first node: the loop of each back edge to a loop header; heads of ifs with what lies before their merge node; heads of switches likewise
    (all they reach, without a merge node); label regions of the rest. A head inside an earlier region opens none."""
    out, into = adjacency(nodes, edges)
    post = post_dominators(nodes, out, into, "first")
    found: list[Region] = [(loop_role, h, b) for h, b in back_edge_loops(entry, nodes, edges) if role[h] == loop_role]
    taken = {n for _, _, b in found for n in b}
    for kind in (if_role, switch_role):
        for h in nodes:
            merge = post.get(h)
            if role[h] != kind or h in taken or not out[h] or (merge is None and kind == if_role):
                continue
            body = sorted({h} | until(out[h], merge, out))
            found.append((kind, h, body))
            taken.update(body)
    return sorted(found + _by_label(nodes, taken, edges, role), key=lambda x: x[2][0])


def compound_regions(nodes: list[int], edges: Edges, compound: dict[int, int], kind: dict[int, int]) -> list[tuple[int, int, list[int]]]:
    """(kind, header, nodes): connected statements of one compound; those without a compound (-1) by equal kind."""
    label = {n: (0, compound[n]) if compound[n] >= 0 else (1, kind[n]) for n in nodes}
    groups: dict[int, list[int]] = {}
    for n, r in label_regions(nodes, edges, label).items():
        groups.setdefault(r, []).append(n)
    return sorted(((kind[r], r, sorted(ns)) for r, ns in groups.items()), key=lambda x: x[1])


#: Names of a block's features, in order.
FEATURES = ["in_degree", "out_degree", "is_loop_header", "is_loop_exit", "dom_depth", "post_dom_depth", "size", "entropy", "has_call", "has_indirect_jump", "dfs_place", "bfs_place"]
#: Columns of a block's own facts, as `block_facts` gives them.
FACTS = ["n_instructions", "entropy", "has_call", "has_indirect_jump", "is_loop_exit"]


def _tree_depths(root: int, nodes: list[int], idom: dict[int, int]) -> dict[int, float]:
    """Steps to the root of a dominator tree; 1 for nodes outside it."""
    depth = {root: 0}
    for n in nodes:
        chain = [n]
        while chain[-1] not in depth and chain[-1] in idom:
            chain.append(idom[chain[-1]])
        start = depth.setdefault(chain[-1], 1)
        for k, m in enumerate(reversed(chain[:-1]), start + 1):
            depth[m] = k
    return {n: float(depth[n]) for n in nodes}


def block_features(entry: int, nodes: list[int], edges: Edges, facts: dict[int, tuple[int, float, bool, bool, bool]] | None = None, back: set[tuple[int, int]] | None = None) -> dict[int, list[float]]:
    """FEATURES of each node. facts: FACTS by block (a block without any has no instructions); back: edges of the back type, by default by the builder's notion.

    Degrees count edges as given. A loop exit is the source of a back-typed edge to a loop header, or a block that is marked as one. Depths are steps in the
    trees of the entry and of the first node without successors (the last node, if there is none); nodes that a tree does not hold have 1, and all 0
    without edges. Sizes are over 64, places over n - 1; successors in the order of the edges, unreachable nodes behind the others by number.
    """
    out, into = adjacency(nodes, edges)
    idom = immediate_dominators(entry, out, into)
    headers = {b for a, b in edges if dominates(idom, b, a)}
    leaving = {a for a, b in edges if b in headers and ((a, b) in back if back is not None else b <= a)}
    last = next((n for n in nodes if not out[n]), nodes[-1])
    depth, post = (_tree_depths(r, nodes, d) if edges else dict.fromkeys(nodes, 0.0) for r, d in ((entry, idom), (last, immediate_dominators(last, into, out))))
    deep, todo = {}, [entry]
    while todo:
        n = todo.pop()
        if n not in deep:
            deep[n] = len(deep)
            todo += reversed(out[n])
    wide, line = {entry: 0}, deque([entry])
    while line:
        for m in out[line.popleft()]:
            if m not in wide:
                wide[m] = len(wide)
                line.append(m)
    for place in (deep, wide):
        for n in nodes:
            place.setdefault(n, len(place))
    scale, rows = max(1, len(nodes) - 1), {}
    for n in nodes:
        size, entropy, call, jump, marked = (facts or {}).get(n, (0, 0.0, False, False, False))
        flags = float(n in headers), float(n in leaving or bool(edges) and bool(marked))
        rows[n] = [float(len(into[n])), float(len(out[n])), *flags, depth[n], post[n], size / 64, float(entropy), float(call), float(jump), deep[n] / scale, wide[n] / scale]
    return rows


def block_facts(instructions: DataFrame, sample: str = "sample") -> DataFrame:
    """One row (sample, facts) per graph out of instruction rows (sample, node, opcode, is_call, is_indirect_jump): structs of the node and FACTS, the entropy
    of its opcodes in bits. No block is marked as a loop exit there."""
    per = instructions.groupBy(sample, "node", "opcode").agg(F.count("*").alias("k"), F.max("is_call").alias("c"), F.max("is_indirect_jump").alias("j"))
    # H = log2(n) - sum(k log2 k) / n
    entropy = F.greatest(F.lit(0.0), F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k"))
    blocks = per.groupBy(sample, "node").agg(F.sum("k").alias("n_instructions"), entropy.alias("entropy"), F.max("c").alias("has_call"), F.max("j").alias("has_indirect_jump")).withColumn("is_loop_exit", F.lit(False))
    return blocks.groupBy(sample).agg(F.collect_list(F.struct("node", *FACTS)).alias("facts"))


def shortest_paths(nodes: list[int], out: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(from, to, steps) of all reachable pairs; for small graphs."""
    return [(n, m, d) for n in nodes for m, d in traversal(n, nodes, out)[2].items()]


def per_graph(graphs: DataFrame, kernel: Callable[..., list[tuple]], schema: str, sample: str = "sample", more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (sample, *kernel's tuples); schema names the tuples' columns. The kernel gets the entry, nodes and edges, then the columns `more` as they are."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = dict(graphs.dtypes)[sample]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (s, *r)
                for s, entry, nodes, edges, *own in zip(batch[sample], batch["entry"], batch["nodes"], batch["edges"], *(batch[c] for c in more), strict=True)
                for r in kernel(int(entry), [int(n) for n in nodes], [(int(e["src"]), int(e["dst"])) for e in edges], *own)
            ]
            yield pd.DataFrame(rows, columns=[sample, *names])

    return graphs.select(sample, "entry", "nodes", "edges", *more).mapInPandas(run, f"{sample} {kind}, {schema}")


def back_edges(src: Column, dst: Column) -> Column:
    """The builder's own notion: a target whose number is not larger."""
    return dst <= src

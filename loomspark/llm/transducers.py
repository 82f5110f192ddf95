"""Weighted finite-state transducers as data: arcs, composition, and the best path through a composed machine.

A machine reads symbols, writes symbols and multiplies the weight of what it reads. An arc is (state, read, written, factor, next state). Machines may have several arcs
for one state and symbol; a path counts only if it ends in a final state. The weight of a path is the sum over its symbols of the symbol's own weight times
the factors of its arcs, and of all paths the one of largest weight is taken.

Cases: an input without symbols has the empty path of weight 0 (if the start is final); an input that no path accepts has none. Of paths of equal weight the first found is taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Arc:
    state: object
    read: str
    written: str
    factor: float
    to: object


@dataclass(frozen=True)
class Machine:
    start: object
    finals: frozenset
    arcs: tuple[Arc, ...]

    def leaving(self) -> dict[tuple[object, str], list[Arc]]:
        out: dict[tuple[object, str], list[Arc]] = {}
        for a in self.arcs:
            out.setdefault((a.state, a.read), []).append(a)
        return out

    def paths(self, symbols: Iterable[str]) -> Iterator[list[Arc]]:
        """All accepted paths, one by one: the plain meaning of the machine."""
        symbols, leaving = list(symbols), self.leaving()

        def walk(state: object, k: int) -> Iterator[list[Arc]]:
            if k == len(symbols):
                if state in self.finals:
                    yield []
                return
            for a in leaving.get((state, symbols[k]), ()):
                for rest in walk(a.to, k + 1):
                    yield [a, *rest]

        return walk(self.start, 0)


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that hands what `first` writes to `second`; only states that can be reached are made."""
    left, right = first.leaving(), second.leaving()
    reads: dict[object, list[Arc]] = {}
    for (state, _), arcs in left.items():
        reads.setdefault(state, []).extend(arcs)
    start = (first.start, second.start)
    arcs, seen, todo = [], {start}, [start]
    while todo:
        p, q = todo.pop()
        for a in reads.get(p, ()):
            for b in right.get((q, a.written), ()):
                to = (a.to, b.to)
                arcs.append(Arc((p, q), a.read, b.written, a.factor * b.factor, to))
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    return Machine(start, frozenset(s for s in seen if s[0] in first.finals and s[1] in second.finals), tuple(arcs))


class Runner:
    """A machine with its states numbered, to follow the best path of each live state."""

    def __init__(self, machine: Machine):
        number = {s: k for k, s in enumerate({machine.start: 0, **{a.state: 0 for a in machine.arcs}, **{a.to: 0 for a in machine.arcs}})}
        self.finals = {number[s] for s in machine.finals if s in number}
        self.arcs: list[dict[str, list[tuple[str, float, int]]]] = [{} for _ in number]
        for a in machine.arcs:
            self.arcs[number[a.state]].setdefault(a.read, []).append((a.written, a.factor, number[a.to]))

    def best(self, symbols: Iterable[tuple[str, float]]) -> tuple[float, dict[str, float], float] | None:
        """Of the best path over (symbol, weight): its weight, the weights by written symbol, and the largest one. Symbols of weight 0 add nothing to these."""
        live: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by state: weight, and what was written as a linked list
        for symbol, weight in symbols:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (total, written) in live.items():
                for out, factor, to in self.arcs[state].get(symbol, ()):
                    value = total + weight * factor
                    if to not in after or value > after[to][0]:
                        after[to] = (value, (out, weight * factor, written) if weight else written)
            live = after
        ends = [x for s, x in live.items() if s in self.finals]
        if not ends:
            return None
        total, written = max(ends, key=lambda x: x[0])
        sums: dict[str, float] = {}
        largest = 0.0
        while written:
            out, value, written = written
            sums[out] = sums.get(out, 0.0) + value
            largest = max(largest, value)
        return total, sums, largest

"""Weighted finite-state transducers over word classes.

A transducer reads one symbol a step and writes one; an arc carries a weight.
The weight of a path is the sum of its arcs, and of several paths that read
the same symbols the heaviest counts (the max-plus semiring).  A path counts
only if it ends in a final state, which lets a machine assume something about
what is yet to come and be held to it.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from typing import NamedTuple


class Arc(NamedTuple):
    out: str
    weight: float
    to: int


class Transducer:
    """States are numbers, 0 the first; ``arcs[state][symbol]`` are the arcs that leave it."""

    def __init__(self, arcs: list[dict[str, list[Arc]]], final: set[int]):
        self._arcs, self._final = arcs, final

    def arcs(self, state: int, symbol: str) -> list[Arc]:
        return self._arcs[state].get(symbol, [])

    def is_final(self, state: int) -> bool:
        return state in self._final

    def __len__(self) -> int:
        return len(self._arcs)


def machine(start: Hashable, alphabet: str, step: Callable[[Hashable, str], Iterable[tuple[str, float, Hashable]]], final: Callable[[Hashable], bool]) -> Transducer:
    """The transducer of all states that ``step`` reaches from ``start``."""
    number, arcs, todo = {start: 0}, [], [start]
    for state in todo:
        row: dict[str, list[Arc]] = {}
        for symbol in alphabet:
            for out, weight, to in step(state, symbol):
                if to not in number:
                    number[to] = len(todo)
                    todo.append(to)
                row.setdefault(symbol, []).append(Arc(out, weight, number[to]))
        arcs.append(row)
    return Transducer(arcs, {number[s] for s in todo if final(s)})


class Composed(Transducer):
    """What one transducer writes is read by the other; states are made when first reached."""

    def __init__(self, first: Transducer, second: Transducer):
        self._first, self._second = first, second
        self._pairs, self._number = [(0, 0)], {(0, 0): 0}
        self._made: list[dict[str, list[Arc]]] = [{}]

    def arcs(self, state: int, symbol: str) -> list[Arc]:
        found = self._made[state].get(symbol)
        if found is None:
            a, b = self._pairs[state]
            found = [Arc(y.out, x.weight + y.weight, self._state(x.to, y.to)) for x in self._first.arcs(a, symbol) for y in self._second.arcs(b, x.out)]
            self._made[state][symbol] = found
        return found

    def _state(self, a: int, b: int) -> int:
        if (a, b) not in self._number:
            self._number[a, b] = len(self._pairs)
            self._pairs.append((a, b))
            self._made.append({})
        return self._number[a, b]

    def is_final(self, state: int) -> bool:
        a, b = self._pairs[state]
        return self._first.is_final(a) and self._second.is_final(b)

    def __len__(self) -> int:
        return len(self._pairs)


def compose(*machines: Transducer) -> Transducer:
    """The cascade of machines, first to last."""
    out = machines[0]
    for m in machines[1:]:
        out = Composed(out, m)
    return out


#: Symbols of one place: what it may be read as, and the weight of that reading.
Readings = list[tuple[str, float]]


def best_path(of: Transducer, places: list[Readings]) -> tuple[float, list[tuple[int, str, float]]]:
    """Weight of the heaviest path, and its steps of weight other than 0: (place, written, weight).

    Places are read one after another; each step keeps the heaviest path to
    every state.  Without a path to a final state the weight is minus infinity.
    """
    now: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for at, readings in enumerate(places):
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (held, steps) in now.items():
            for symbol, given in readings:
                for out, weight, to in of.arcs(state, symbol):
                    total = held + given + weight
                    if to not in after or total > after[to][0]:
                        after[to] = (total, (steps, at, out, given + weight) if given or weight else steps)
        now = after
    ends = [(w, s) for state, (w, s) in now.items() if of.is_final(state)]
    if not ends:
        return float("-inf"), []
    total, steps = max(ends, key=lambda e: e[0])
    path = []
    while steps is not None:
        steps, at, out, weight = steps
        path.append((at, out, weight))
    return total, path[::-1]

"""Small weighted finite-state transducers over word classes."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

Symbol = Hashable


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step(state, symbol)`` gives the next state, the output symbol and a log weight."""

    start: Hashable
    step: Callable[[Hashable, Symbol], tuple[Hashable, Symbol, float]]

    def then(self, after: Transducer) -> Transducer:
        """The composition: what this one writes, ``after`` reads; log weights add."""

        def step(state, symbol):
            mine, other = state
            mine, middle, first = self.step(mine, symbol)
            other, out, second = after.step(other, middle)
            return (mine, other), out, first + second

        return Transducer((self.start, after.start), step)

    def table(self, symbols: Iterable[Symbol]) -> Table:
        """All states that ``symbols`` can reach, numbered, with their arcs."""
        symbols = list(symbols)
        numbers, queue, arcs = {self.start: 0}, [self.start], []
        for state in queue:
            row = []
            for symbol in symbols:
                target, out, weight = self.step(state, symbol)
                if target not in numbers:
                    numbers[target] = len(queue)
                    queue.append(target)
                row.append((numbers[target], out, weight))
            arcs.append(row)
        return Table({symbol: k for k, symbol in enumerate(symbols)}, arcs)


@dataclass(frozen=True)
class Table:
    """A compiled transducer: ``arcs[state][symbol number]``; state 0 is the start."""

    number: dict[Symbol, int]
    arcs: list[list[tuple[int, Symbol, float]]]


def within(trigger: str, reach: int, marks: str, factor: float, kinds: frozenset[str]) -> Transducer:
    """Marks words of ``kinds`` that stand at most ``reach`` words behind a ``trigger`` word.

    Symbols are (kind, marks so far). A marked word gets ``log factor`` as its weight.
    """
    import math

    def step(left, symbol):
        kind, marked = symbol
        if kind == "end":
            return 0, symbol, 0.0
        weight, out = 0.0, symbol
        if left and kind in kinds:
            out, weight = (kind, marked | {marks}), math.log(factor)
        left = reach if kind == trigger else max(0, left - 1)
        return left, out, weight

    return Transducer(0, step)

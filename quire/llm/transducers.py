"""Small deterministic transducers over symbols, their composition, and weights on what they put out."""

from __future__ import annotations

from collections.abc import Callable, Hashable


class Transducer:
    """step(state, symbol) gives (next state, symbol put out); states and symbols are hashable."""

    def __init__(self, start: Hashable, step: Callable):
        self.start, self.step = start, step

    def __matmul__(self, after: Transducer) -> Transducer:
        """The transducer that feeds what this one puts out to the other; its states are pairs."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = after.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, after.start), step)

    def compiled(self, symbols) -> tuple[list[dict], list[dict]]:
        """(next state, output) tables by state number and symbol, of all states that symbols reach from the start."""
        numbers, todo, go, put = {self.start: 0}, [self.start], [], []
        for state in todo:
            go.append({})
            put.append({})
            for s in symbols:
                then, out = self.step(state, s)
                if then not in numbers:
                    numbers[then] = len(numbers)
                    todo.append(then)
                go[-1][s], put[-1][s] = numbers[then], out
        return go, put


def within(trigger: str, reach: int, mark: str, on: frozenset) -> Transducer:
    """Marks symbols whose kind is in on and that come at most reach symbols after a trigger. reach 0: up to the end.

    A symbol is (kind, marks); the trigger itself goes on unmarked.
    """

    def step(left, symbol):
        kind, marks = symbol
        if kind == trigger:
            return (reach or -1), symbol
        out = (kind, marks | {mark}) if left and kind in on else symbol
        return (left - 1 if left > 0 else left), out

    return Transducer(0, step)

"""Weighted finite-state repair: an edit transducer composed lazily with a grammar, and the least path through both.

The input acceptor is a sequence of symbols; composed states are (place in the input, inserts since then, grammar
state). Edits cost something unless they keep a symbol, so a least path never meets a composed state twice and needs
fewer inserts in a row than the grammar has states. With inserts counted up to that, the composition has no cycle:
its arcs go to the next place or to one insert more.

Weights are pairs (cost, labels), summed by cost and text, compared by cost and then by text. The arcs of a composed
state have different labels, so of two paths from it the one whose first label is less has the lesser text, and the
least weight to the end follows from the weights behind its arcs alone: one pass against topological order. What a
place makes of the weights behind it depends on its symbol and their differences only, of which there are few; they
are kept, so a place costs a look-up, and memory is two small numbers a place.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of output symbols; states are 0 (the start) to states - 1."""

    states: int
    step: dict[tuple[int, str], int]
    finals: frozenset[int]


@dataclass(frozen=True)
class Edits:
    """An edit transducer with one state: what may become of an input symbol, and what may be put between.

    ``uses[symbol]``: (label, cost, output or None) for each edit of the symbol; ``inserts``: (label, cost, output).
    """

    uses: dict[Hashable, tuple[tuple[str, int, str | None], ...]]
    inserts: tuple[tuple[str, int, str], ...]


@dataclass
class Composition:
    """``edits`` composed with ``grammar``; states and weights are made when an input first asks for them."""

    edits: Edits
    grammar: Grammar
    _arcs: dict = field(default_factory=dict)
    _ahead: dict = field(default_factory=dict)
    _behind: dict = field(default_factory=dict)

    def arcs(self, symbol: Hashable | None, state: int) -> list[tuple[str, int, bool, int]]:
        """(label, cost, whether the symbol is used, next state) of a composed state; no symbol at the end."""
        key = symbol, state
        if key not in self._arcs:
            put, at = divmod(state, self.grammar.states)
            out = []
            for label, cost, said in self.edits.uses[symbol] if symbol is not None else ():
                after = at if said is None else self.grammar.step.get((at, said))
                if after is not None:
                    out.append((label, cost, True, after))
            for label, cost, said in self.edits.inserts if put < self.grammar.states - 1 else ():
                if (after := self.grammar.step.get((at, said))) is not None:
                    out.append((label, cost, False, (put + 1) * self.grammar.states + after))
            if len({x[0] for x in out}) < len(out) or any(x[1] <= 0 and not x[2] for x in out):
                raise ValueError("arcs of a state need different labels, and inserts a positive cost")
            self._arcs[key] = out
        return self._arcs[key]

    def ahead(self, states: tuple[int, ...], symbol: Hashable | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """All states of a place, given those entered from before, and the states entered at the next place."""
        key = states, symbol
        if key not in self._ahead:
            here, after, todo = set(states), set(), list(states)
            while todo:
                for _, _, used, to in self.arcs(symbol, todo.pop()):
                    if used:
                        after.add(to)
                    elif to not in here:
                        here.add(to)
                        todo.append(to)
            self._ahead[key] = tuple(sorted(here)), tuple(sorted(after))
        return self._ahead[key]

    def behind(self, states: tuple[int, ...], symbol: Hashable | None, rest: tuple[tuple[int, int], ...]) -> tuple[int, tuple[tuple[int, int], ...], dict[int, tuple[str, bool, int]]]:
        """Least costs of a place's states above their least, that least, and each state's first arc.

        ``rest``: (state, cost) at the next place.
        """
        key = states, symbol, rest
        if key not in self._behind:
            costs, first, later = {}, {}, dict(rest)
            for state in reversed(states):  # more inserts first: an insert leads to a state already known
                found = [(0, "", False, -1)] if symbol is None and state % self.grammar.states in self.grammar.finals else []
                for label, cost, used, to in self.arcs(symbol, state):
                    if (more := (later if used else costs).get(to)) is not None:
                        found.append((cost + more, label, used, to))
                if found:
                    cost, label, used, to = min(found)
                    costs[state], first[state] = cost, (label, used, to)
            least = min(costs.values(), default=0)
            self._behind[key] = least, tuple((s, c - least) for s, c in costs.items()), first
        return self._behind[key]

    def least(self, symbols: Sequence[Hashable]) -> tuple[int, str] | None:
        """Cost and labels of the least path; None if the grammar can't be met."""
        entered, layers = (0,), []
        for symbol in [*symbols, None]:
            here, entered = self.ahead(entered, symbol)
            layers.append(here)
        rest: tuple[tuple[int, int], ...] = ()
        total, firsts = 0, []
        for i in range(len(symbols), -1, -1):
            least, rest, first = self.behind(layers[i], symbols[i] if i < len(symbols) else None, rest)
            total += least
            firsts.append(first)
        cost = dict(rest).get(0)
        if cost is None:
            return None
        labels, state, place = [], 0, 0
        while True:
            label, used, state = firsts[len(symbols) - place][state]
            if state < 0:
                return total + cost, "".join(labels)
            labels.append(label)
            place += used

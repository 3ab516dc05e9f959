"""Grammar inference: probabilistic automata by merging states of a prefix tree.

A sample of strings becomes a prefix tree with counts. States are visited in breadth-first order; one
that is statistically compatible with a state already kept is folded into it, any other is kept as
well. What remains is a deterministic automaton whose transitions and ends carry probabilities.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable


class Automaton:
    """States with probabilities of each next symbol and of ending there."""

    def __init__(self, steps: list[dict[str, tuple[int, float]]], ends: list[float]):
        # steps[state][symbol] = (next state, log probability); ends[state] = log probability
        self.steps, self.ends = steps, ends

    def score(self, text: str, floor: float = -math.inf) -> float:
        """Log likelihood of ``text``. A symbol or an end that the state does not know costs ``floor``
        (an unknown symbol leads back to the start); without a floor such a text is impossible.
        """
        steps, state, total = self.steps, 0, 0.0
        for symbol in text:
            found = steps[state].get(symbol)
            if found is None:
                if floor == -math.inf:
                    return floor
                state, total = 0, total + floor
            else:
                state, total = found[0], total + max(found[1], floor)
        return total + max(self.ends[state], floor)


class _Tree:
    def __init__(self, strings: Iterable[str]):
        self.passed, self.ended, self.next = [0], [0], [{}]
        for text in strings:
            state = 0
            self.passed[0] += 1
            for symbol in text:
                below = self.next[state].get(symbol)
                if below is None:
                    below = self.next[state][symbol] = len(self.next)
                    self.passed.append(0)
                    self.ended.append(0)
                    self.next.append({})
                state = below
                self.passed[state] += 1
            self.ended[state] += 1

    def count(self) -> None:
        """How often each symbol leaves each state: in a tree, how often the state below is passed."""
        self.left = [{s: self.passed[below] for s, below in steps.items()} for steps in self.next]

    def compatible(self, kept: int, other: int, strictness: float) -> bool:
        """Hoeffding's bound on ends and symbols, here and wherever both go on alike."""
        open_pairs = [(kept, other)]
        while open_pairs:
            a, b = open_pairs.pop()
            n, m = self.passed[a], self.passed[b]
            bound = strictness * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1:
                if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                    return False
                here, there = self.left[a], self.left[b]
                for symbol in {*here, *there}:
                    if abs(here.get(symbol, 0) / n - there.get(symbol, 0) / m) > bound:
                        return False
            for symbol, below in self.next[b].items():
                if symbol in self.next[a]:
                    open_pairs.append((self.next[a][symbol], below))
        return True

    def fold(self, kept: int, other: int) -> list[tuple[int, str]]:
        """Add the tree below ``other`` to ``kept`` and what follows it; returns the edges added."""
        open_pairs, added = [(kept, other)], []
        while open_pairs:
            a, b = open_pairs.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for symbol, below in sorted(self.next[b].items()):
                self.left[a][symbol] = self.left[a].get(symbol, 0) + self.left[b][symbol]
                if symbol in self.next[a]:
                    open_pairs.append((self.next[a][symbol], below))
                else:
                    self.next[a][symbol] = below
                    added.append((a, symbol))
        return added


def infer(strings: Iterable[str], alpha: float = 0.05) -> Automaton | None:
    """The automaton of a sample; None for an empty one. ``alpha`` is the chance of keeping apart
    two states that are alike. The result does not depend on the order of the sample.
    """
    tree = _Tree(sorted(strings))
    if not tree.passed[0]:
        return None
    tree.count()
    strictness = math.sqrt(0.5 * math.log(2 / alpha))
    kept, known = [0], {0}
    # Edges out of kept states; what hangs below them is still a tree.
    edges = deque((0, symbol) for symbol in sorted(tree.next[0]))
    while edges:
        parent, symbol = edges.popleft()
        state = tree.next[parent][symbol]
        if state in known:
            continue
        like = next((old for old in kept if tree.compatible(old, state, strictness)), None)
        if like is None:
            kept.append(state)
            known.add(state)
            edges.extend((state, s) for s in sorted(tree.next[state]))
        else:
            tree.next[parent][symbol] = like
            edges.extend(edge for edge in tree.fold(like, state) if edge[0] in known)
    number = {state: i for i, state in enumerate(kept)}
    steps, ends = [], []
    for state in kept:
        n = tree.passed[state]
        steps.append(
            {s: (number[below], math.log(tree.left[state][s] / n)) for s, below in tree.next[state].items()}
        )
        ends.append(math.log(tree.ended[state] / n) if tree.ended[state] else -math.inf)
    return Automaton(steps, ends)

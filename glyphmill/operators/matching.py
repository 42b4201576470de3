"""Matching blocks of two word sequences: the longest common run, then the same to its left and to its right.

A suffix automaton of one side reads the other once, so a run costs time in proportion to both lengths, however often
words repeat. Of runs as long, the one that comes first on the left side counts, then first on the right.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


class Automaton:
    """All runs of a sequence; state 0 is the empty run."""

    def __init__(self, items: Sequence[Hashable]):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]  # first: where a state's runs end first
        last = 0
        for at, item in enumerate(items):
            last = self._grown(last, item, at)

    def _state(self, moves: dict, link: int, size: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.next) - 1

    def _grown(self, last: int, item: Hashable, at: int) -> int:
        made, p = self._state({}, 0, self.size[last] + 1, at), last
        while p >= 0 and item not in self.next[p]:
            self.next[p][item] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][item]
            if self.size[q] != self.size[p] + 1:  # q also holds longer runs, which do not end here: split them off
                q, longer = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1, self.first[q]), q
                self.link[longer] = q
                while p >= 0 and self.next[p].get(item) == longer:
                    self.next[p][item] = q
                    p = self.link[p]
            self.link[made] = q
        return made

    def longest(self, items: Sequence[Hashable]) -> tuple[int, int, int]:
        """(start in items, start in the automaton's sequence, length) of the longest common run; length 0 if none."""
        state = size = best = end = other = 0
        moves, link, sizes = self.next, self.link, self.size
        for at, item in enumerate(items):
            while state and item not in moves[state]:
                state = link[state]
                size = sizes[state]
            if item in moves[state]:
                state, size = moves[state][item], size + 1
                if size > best:
                    best, end, other = size, at + 1, self.first[state] + 1
        return end - best, other - best, best


def blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> Iterator[tuple[int, int, int]]:
    """(start in a, start in b, length) of all matching blocks, in no order."""
    left = [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = Automaton(b[b0:b1]).longest(a[a0:a1])
        if n:
            i, j = a0 + i, b0 + j
            yield i, j, n
            left += [(a0, i, b0, j), (i + n, a1, j + n, b1)]


def matched(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """How many items all matching blocks hold."""
    return sum(n for _, _, n in blocks(a, b))

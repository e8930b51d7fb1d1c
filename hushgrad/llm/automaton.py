"""A generalised suffix automaton over word ids of many items, with what each state says about windows."""

from __future__ import annotations

from itertools import repeat

import numpy as np


class Automaton:
    """All word runs of the items. Windows are runs of `window` words; a shorter item is one window as a whole."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []  # states where a whole short item ends, and the item
        windows: list[tuple[int, list[int]]] = []
        self.items = [name for name, _ in items]
        self.shortest = min((min(len(ws), window) for _, ws in items if ws), default=0)
        runs = [[self.words.setdefault(w, len(self.words)) for w in ws] for _, ws in items]
        for i, run in enumerate(runs):
            last = 0
            for c in run:
                last = self._extend(last, c)
            if 0 < len(run) < window:
                ends.append((i, len(run)))
            elif run:
                windows.append((i, run))
        # Which items own the window that ends in a state: each item is walked once more.
        self.owners: dict[int, set[int]] = {}
        for i, run in windows:
            for state, n in self._walk(run):
                if n >= window:
                    self.owners.setdefault(self._cut(state, window), set()).add(i)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, n in ends:
            state = 0
            for c in runs[i]:
                state = self.next[state][c]
            self.short.setdefault(state, []).append((n, i))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _walk(self, run):
        """For each word the state and the length of the longest run of item words that ends there."""
        state, n = 0, 0
        for c in run:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            yield state, n

    def _cut(self, state: int, n: int) -> int:
        """The state of the last n words of what a state stands for."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs [begin, end) of words that lie inside occurring windows, merged and in order; items with such windows."""
        if not self.shortest:
            return [], set()
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        begins, ends = known[::2], known[1::2]
        long_enough = ends - begins >= self.shortest
        for b, e in zip(begins[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            for at, (state, n) in enumerate(self._walk(ids[b:e].tolist()), b + 1):
                size = 0
                if n >= self.window:
                    size = n
                    found |= self.owners.get(self._cut(state, self.window), set())
                if self.short:
                    s = state
                    while s > 0:
                        for k, i in self.short.get(s, ()):
                            if k <= n:
                                size = max(size, k)
                                found.add(i)
                        s = self.link[s]
                if size:
                    while spans and spans[-1][1] >= at - size:
                        size = max(size, at - spans.pop()[0])
                    spans.append((at - size, at))
        return spans, found

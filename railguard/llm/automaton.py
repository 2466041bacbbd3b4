"""Generalised suffix automaton over word sequences, and matching lengths of a word stream.

The automaton of all items of a block accepts every run of words of every item. Streaming
words through it keeps the state of the longest suffix of the stream that some item
contains; its length tells which windows end at the current word.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

WINDOW = 13


class SuffixAutomaton:
    """Built from (item, words) pairs; states are numbers, words are small integers."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        reached = nxt[last].get(word)
        if reached is not None:  # another item already has this run
            if length[reached] == length[last] + 1:
                return reached
            return self._clone(last, word, reached)
        state = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p < 0:
            link[state] = 0
        elif length[nxt[p][word]] == length[p] + 1:
            link[state] = nxt[p][word]
        else:
            link[state] = self._clone(p, word, nxt[p][word])
        return state

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, word: int, old: int) -> int:
        """Split ``old``: the runs that also end elsewhere get a state of their own."""
        copy = self._state(self.length[p] + 1, dict(self.next[old]))
        self.link[copy], self.link[old] = self.link[old], copy
        while p >= 0 and self.next[p].get(word) == old:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def build(self, items: list[tuple[object, list[bytes], bool]]) -> SuffixAutomaton:
        """Items are (id, words, whole): a whole item shorter than a window is one window."""
        coded = []
        for item, words, whole in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item, ids, whole))
            last = 0
            for word in ids:
                last = self._extend(last, word)
        return self._mark(coded)

    def _mark(self, coded) -> SuffixAutomaton:
        n, window, link, length = len(self.next), self.window, self.link, self.length
        order = sorted(range(1, n), key=length.__getitem__)
        #: The state of the last ``window`` words of a state's runs, where they are that long.
        self.top = [0] * n
        for v in order:
            if length[v] >= window:
                self.top[v] = v if length[link[v]] < window else self.top[link[v]]
        found: dict[int, set] = defaultdict(set)
        short: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for item, ids, whole in coded:
            v = 0
            for i, word in enumerate(ids):
                v = self.next[v][word]
                if i + 1 >= window:
                    found[self.top[v]].add(item)
            if whole and 0 < len(ids) < window:
                short[v][len(ids)].add(item)
        self.items = {v: frozenset(x) for v, x in found.items()}
        #: Short items that end at a state, as (words, number), longest first.
        groups: list[frozenset] = []
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        for v in order:
            own = []
            for k in sorted(short.get(v, ()), reverse=True):
                groups.append(frozenset(short[v][k]))
                own.append((k, len(groups) - 1))
            self.short[v] = (*own, *self.short[link[v]]) if link[v] > 0 else tuple(own)
        self.short_items = groups
        return self

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges [start, end) inside occurrences of windows, and the items they are of."""
        nxt, link, length, short, top = self.next, self.link, self.length, self.short, self.top
        window = self.window
        spans: list[tuple[int, int]] = []
        tops: set[int] = set()
        groups: set[int] = set()
        v = run = 0
        for i, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                v = run = 0
                continue
            to = nxt[v].get(word)
            if to is None:
                while v and to is None:
                    v = link[v]
                    to = nxt[v].get(word)
                if to is None:
                    v = run = 0
                    continue
                run = length[v] + 1
            else:
                run += 1
            v = to
            reach = 0
            if run >= window:
                reach = run
                tops.add(top[v])
            if short[v]:
                for k, group in short[v]:
                    if k <= run:
                        groups.add(group)
                        reach = max(reach, k)
            if reach:
                start = i - reach + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        items: set = set()
        for t in tops:
            items |= self.items[t]
        for g in groups:
            items |= self.short_items[g]
        return spans, items

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__, protocol=pickle.HIGHEST_PROTOCOL)

    @classmethod
    def load(cls, data: bytes) -> SuffixAutomaton:
        made = cls()
        made.__dict__.update(pickle.loads(data))
        return made

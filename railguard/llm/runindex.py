"""Run-length index of a block of byte strings, and matching against smaller documents.

The suffixes of all strings are sorted (every string ends in a separator of its own), the
Burrows-Wheeler transform is kept as runs, with the text position of the suffix at the end of
every run. One backward step of any position is one look-up of its run. All strings are
streamed through the index together, last byte first; at every byte the suffix interval of
the next ``length`` bytes tells the smallest document that has them.
"""

from __future__ import annotations

import numpy as np

#: Symbols that are packed into the first sort key at most.
PACKED = 7


class RunLengthIndex:
    def __init__(self, texts: list[bytes], docs: np.ndarray, length: int):
        """``docs`` has the document of each text; matches of ``length`` bytes are looked for.

        Steps are defined for bytes: a text is read from its last byte to its first one.
        """
        if length < PACKED:
            raise ValueError(f"matches of at least {PACKED} bytes can be looked for")
        count = len(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, count)
        ends = np.cumsum(self.sizes + 1)
        self.first = ends - self.sizes - 1
        n = int(ends[-1]) if count else 0
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8) + np.int64(1)
        owner = np.repeat(np.arange(count), self.sizes + 1)
        order, interval = self._sort(symbols, length)
        before = symbols[order - 1]
        starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.run_starts = starts
        self.run_symbols = before[starts]
        run_sizes = np.diff(np.r_[starts, n])
        #: Text positions of the suffixes at the ends of the runs.
        self.run_end_samples = order[starts + run_sizes - 1]
        # Where the first suffix of a run goes in one backward step: the place of its symbol
        # plus the earlier runs of that symbol.
        by_symbol = np.lexsort((starts, self.run_symbols))
        self.run_targets = np.empty(len(starts), np.int64)
        self.run_targets[by_symbol] = np.cumsum(run_sizes[by_symbol]) - run_sizes[by_symbol]
        # Suffix intervals that agree in ``length`` bytes, and the smallest document of each.
        of_rank = interval[order]
        self.interval_starts = np.flatnonzero(np.r_[True, of_rank[1:] != of_rank[:-1]])
        self.interval_least = np.minimum.reduceat(docs[owner][order], self.interval_starts)
        self.docs, self.length = docs, length
        # The run and the interval of every rank: a look-up instead of a search.
        self._run = np.repeat(np.arange(len(starts), dtype=np.int32), run_sizes)
        self._interval = np.repeat(
            np.arange(len(self.interval_starts), dtype=np.int32), np.diff(np.r_[self.interval_starts, n])
        )

    @staticmethod
    def _sort(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by prefix doubling, and for each position the class of its first
        ``length`` symbols. ``symbols``: 0 for a separator, else the byte plus one."""
        n = len(symbols)
        bits = n.bit_length()
        place = np.arange(n, dtype=np.uint64)

        def ranks(key: np.ndarray, alone: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, bool]:
            """Dense ranks of the keys (of ``width`` bits); ``alone`` marks keys that equal no other."""
            if width + bits <= 64:  # key and place in one number
                packed = key << np.uint64(bits) | place
                packed.sort()
                order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
                packed >>= np.uint64(bits)
            else:
                order = np.argsort(key, kind="stable")
                packed = key[order]
            fresh = np.zeros(n, bool)
            fresh[1:] = packed[1:] != packed[:-1]
            if alone is not None:
                fresh[1:] |= alone[order][1:]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(fresh)
            return rank, order, bool(fresh[1:].all())

        def joined(rank: np.ndarray, shift: int) -> np.ndarray:
            key = rank << np.uint64(bits)
            if shift < n:
                key[: n - shift] |= rank[shift:] + np.uint64(1)
            return key

        # As many symbols as fit one key with the place. Behind a separator nothing is compared:
        # separators are distinct, in the order of their texts, so such keys equal no other.
        present = np.flatnonzero(np.bincount(symbols, minlength=257)[1:]) + 1
        code = np.zeros(257, np.uint64)
        code[present] = np.arange(1, len(present) + 1)
        each = max(1, len(present).bit_length())
        known = max(1, min(PACKED, (64 - bits) // each))
        coded = code[symbols]
        key, open_ = coded.copy(), symbols > 0
        for k in range(1, known):
            after = np.zeros(n, np.uint64)
            after[: n - k] = coded[k:] if k < n else 0
            after[~open_] = 0
            key = key << np.uint64(each) | after
            open_ &= after > 0
        rank, order, done = ranks(key, ~open_, known * each)
        interval = None
        while not done or interval is None:
            if interval is None and (done or 2 * known >= length):
                interval = rank if done else ranks(joined(rank, length - known), None, 2 * bits)[0]
            if not done:
                rank, order, done = ranks(joined(rank, known), None, 2 * bits)
                known *= 2
        return order, interval

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol before the suffix of each rank, and the rank of the suffix that it opens."""
        run = self._run[at]
        return self.run_symbols[run], self.run_targets[run] + at - self.run_starts[run]

    def matched(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, offset) wherever the next ``length`` bytes are in a smaller document too."""
        texts = np.flatnonzero(self.sizes >= self.length)
        at = texts.copy()  # the suffix of separator i has rank i
        left = self.sizes[texts].copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(texts):
            _, at = self.step(at)
            left -= 1
            whole = self.sizes[texts] - left >= self.length
            if whole.any():
                smaller = self.interval_least[self._interval[at[whole]]] < self.docs[texts[whole]]
                found.append((texts[whole][smaller], left[whole][smaller]))
            more = left > 0
            texts, at, left = texts[more], at[more], left[more]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

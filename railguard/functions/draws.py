"""Deterministic pseudo-random indices as integer arithmetic.

The draw depends only on (seed, position), so a lost executor recomputes the same
replicates and any engine with 64-bit integers gives the same numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# A Mersenne prime and multipliers; x -> x**5 permutes residues modulo it.
MODULUS = 2147483647
MULTIPLIER = 48271
STEPS = (15485863, 32452843, 49979687, 67867967)


def uniform_index(size: Column, seed: int, *parts: Column) -> Column:
    """Index in [0, size) for the draw identified by ``parts`` (non-negative integers)."""
    x: Column = F.lit(seed * 104729 + 1).cast("bigint")
    for step, part in zip(STEPS, parts):
        x = x + F.lit(step).cast("bigint") * part.cast("bigint")
    m = F.lit(MODULUS).cast("bigint")
    x = x % m
    square = (x * x) % m
    mixed = (((square * square) % m) * x) % m
    return ((mixed * F.lit(MULTIPLIER).cast("bigint")) % m) % size.cast("bigint")


def uniform_index_sql(size: str, seed: int, *parts: str) -> str:
    """The same draw as SQL text."""
    terms = [f"{step}::BIGINT * {part}" for step, part in zip(STEPS, parts)]
    x = f"(({seed * 104729 + 1}::BIGINT + {' + '.join(terms)}) % {MODULUS})"
    square = f"(({x} * {x}) % {MODULUS})"
    mixed = f"(((({square} * {square}) % {MODULUS}) * {x}) % {MODULUS})"
    return f"((({mixed} * {MULTIPLIER}) % {MODULUS}) % {size})"


def uniform_index_array(size: int, seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """The same draw for whole arrays of positions (which broadcast against each other)."""
    x = np.int64(seed * 104729 + 1)
    for step, part in zip(STEPS, parts):
        x = x + np.int64(step) * np.asarray(part, np.int64)
    x = x % MODULUS
    square = (x * x) % MODULUS
    mixed = (((square * square) % MODULUS) * x) % MODULUS
    return ((mixed * MULTIPLIER) % MODULUS) % size


# Draws whose one part runs over 0, 1, 2, ... are a stretch of neighbours on one ring: with the
# step S of that part, x = start + S * j = S * (place + j) modulo the prime. So all replicates
# draw from the same ring of MODULUS places, and no place has to be worked out more than once.

#: Places worked out at a time.
PLACES_HELD = 1 << 15


def first_place(seed: int, running: int, *parts: np.ndarray | int) -> np.ndarray:
    """Place on the ring of part ``running`` of the draw where that part is 0 (it is given as 0)."""
    x = np.int64(seed * 104729 + 1)
    for step, part in zip(STEPS, parts):
        x = x + np.int64(step) * np.asarray(part, np.int64)
    return (x % MODULUS) * pow(STEPS[running], -1, MODULUS) % MODULUS


def _folded(x: np.ndarray) -> np.ndarray:
    """Congruent modulo the Mersenne prime and at most four above it, for any 64-bit number."""
    low, shift = np.uint64(MODULUS), np.uint64(31)
    x = (x & low) + (x >> shift)
    return (x & low) + (x >> shift)


def index_at(places: np.ndarray, running: int, size: int) -> np.ndarray:
    """``uniform_index_array`` at ``places`` of the ring of part ``running``."""
    x = _folded(places.astype(np.uint64) * np.uint64(STEPS[running]))
    square = _folded(x * x)
    mixed = _folded(_folded(_folded(square * square) * x) * np.uint64(MULTIPLIER))
    mixed = np.where(mixed >= MODULUS, mixed - np.uint64(MODULUS), mixed)
    return (mixed - mixed // np.uint64(size) * np.uint64(size)).view(np.int64)


def stretch_sums(
    values: np.ndarray, running: int, starts: np.ndarray, low: int, high: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the whole-number rows ``values`` that stretches of as many draws name.

    Only places in [low, high) count. Returns the numbers of the stretches that have some and
    their sums, a row each; a stretch that passes the end of the ring may come twice.
    """
    m, columns = len(values), [np.ascontiguousarray(c) for c in values.T]
    number = np.tile(np.arange(len(starts)), 2)
    begin = np.concatenate((starts, starts - MODULUS))
    begin, end = np.maximum(begin, low), np.minimum(begin + m, high)
    number, begin, end = (a[begin < end] for a in (number, begin, end))
    if not len(number):
        return number, np.empty((0, values.shape[1]), np.int64)
    by_begin = np.argsort(begin, kind="stable")
    number, begin, end = number[by_begin], begin[by_begin], end[by_begin]
    # Runs: places that some stretch covers without a gap. Their places are counted through.
    reach = np.maximum.accumulate(end)
    opens = np.concatenate(([True], begin[1:] > reach[:-1]))
    first = begin[opens]
    lengths = reach[np.concatenate((opens[1:], [True]))] - first
    ends = np.cumsum(lengths)
    ahead = first - (ends - lengths)  # from a counted place to the ring
    run = np.cumsum(opens) - 1
    # Sums are wanted up to these counted places; 64-bit differences are right even if sums wrap.
    wanted, back = np.unique(np.concatenate((begin - ahead[run], end - ahead[run])), return_inverse=True)
    upto = np.zeros((len(wanted), values.shape[1]), np.int64)
    carry = np.zeros(values.shape[1], np.int64)
    for at in range(0, int(ends[-1]), PLACES_HELD):
        stop = min(at + PLACES_HELD, int(ends[-1]))
        a, b = np.searchsorted(ends, [at, stop - 1], "right")
        cuts = np.clip(np.concatenate(([at], ends[a:b], [stop])), at, stop)
        places = np.arange(at, stop) + np.repeat(ahead[a : b + 1], np.diff(cuts))
        index = index_at(places, running, m)
        a, b = np.searchsorted(wanted, [at, stop], "right")
        for k, column in enumerate(columns):
            sums = np.cumsum(column[index])
            upto[a:b, k] = sums[wanted[a:b] - at - 1] + carry[k]
            carry[k : k + 1] += sums[-1:]
    half = len(number)
    return number, upto[back[half:]] - upto[back[:half]]

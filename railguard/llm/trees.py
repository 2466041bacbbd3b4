"""Gradient-boosted trees on binned columns, flattened into node arrays for scoring.

Second-order boosting of the logistic loss. A column can be declared monotone: splits whose
leaves would break the declared order are refused, and the halves of an allowed split get
bounds that keep every later leaf in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees; a leaf has feature -1. ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row: all rows step down all trees together, level by level."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            below = x[rows, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class _Nodes:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for name, empty in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
            getattr(self, name).append(empty)
        return len(self.feature) - 1


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    least: int = 10,
    l2: float = 1.0,
) -> Forest:
    """Boost ``trees`` trees on rows ``x`` and 0/1 labels ``y``; ``monotone`` has -1, 0 or 1."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes, roots = _Nodes(), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(nodes.add())
        grown = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while grown:
            node, rows, low, high, level = grown.pop()
            g, h = grad[rows], hess[rows]
            leaf = float(np.clip(-g.sum() / (h.sum() + l2), low, high))
            nodes.value[node] = rate * leaf
            best = _split(binned[rows], g, h, edges, monotone, least, l2, low, high) if level < depth else None
            if best is None:
                margin[rows] += nodes.value[node]
                continue
            _, j, cut, a, b = best
            nodes.feature[node], nodes.threshold[node] = j, float(edges[j][cut])
            nodes.left[node], nodes.right[node] = nodes.add(), nodes.add()
            mid = (a + b) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high),) * 2}[monotone[j]]
            below = binned[rows, j] <= cut
            grown.append((nodes.left[node], rows[below], *bounds[0], level + 1))
            grown.append((nodes.right[node], rows[~below], *bounds[1], level + 1))
    return Forest(
        np.array(nodes.feature),
        np.array(nodes.threshold),
        np.array(nodes.left),
        np.array(nodes.right),
        np.array(nodes.value),
        np.array(roots),
        depth,
        base,
    )


def _split(binned, g, h, edges, monotone, least, l2, low, high):
    """The split of largest gain as (gain, column, cut, left value, right value)."""
    whole_g, whole_h, best = g.sum(), h.sum(), None
    for j, e in enumerate(edges):
        if not len(e):
            continue
        size = len(e) + 1
        gl = np.cumsum(np.bincount(binned[:, j], g, size))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], h, size))[:-1]
        nl = np.cumsum(np.bincount(binned[:, j], minlength=size))[:-1]
        gr, hr = whole_g - gl, whole_h - hl
        a, b = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
        gain = -(gl * a + gr * b + 0.5 * ((hl + l2) * a**2 + (hr + l2) * b**2))
        allowed = (nl >= least) & (len(g) - nl >= least)
        if monotone[j]:
            allowed &= monotone[j] * (b - a) >= 0
        if not allowed.any():
            continue
        cut = int(np.argmax(np.where(allowed, gain, -np.inf)))
        if best is None or gain[cut] > best[0]:
            best = (float(gain[cut]), j, cut, float(a[cut]), float(b[cut]))
    value = float(np.clip(-whole_g / (whole_h + l2), low, high))
    stay = -(whole_g * value + 0.5 * (whole_h + l2) * value**2)
    return best if best is not None and best[0] > stay + 1e-9 else None

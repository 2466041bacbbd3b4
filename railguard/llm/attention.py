"""A small causal self-attention model in numpy, with its gradients.

One attention layer looks from the last known subword back over a window; its output and
the subword's own vector predict the *class* of the next subword. The probability of a
subword is that of its class times its share of the class in the counted corpus, so the
model is a proper distribution over the whole vocabulary at the cost of a small softmax.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

WIDTH = 16
CLASSES = 64
#: Of those classes, the most frequent subwords have one each.
SINGLES = 40
#: Subwords scored per window, and earlier ones that a window shares with the one before.
SCORED, SHARED = 16, 7
#: Ids before a subword that its profile tells apart; the last place is for all others.
PROFILE = 128
KEYS = SCORED + SHARED

#: Windows worked on at a time, so that what lies between the steps stays in a core's cache.
BLOCK = 128

_DISTANCE = np.arange(SHARED, KEYS)[:, None] - np.arange(KEYS)[None, :]
_CAUSAL = np.where(_DISTANCE >= 0, 0, -30).astype(np.float32)
_FAR = np.maximum(_DISTANCE, 0)
_ONES = np.ones(max(CLASSES, KEYS), np.float32)


def windows(sequences: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of all sequences: ids (n, KEYS), targets (n, SCORED), sequence of each.

    A sequence starts with the boundary id; every later id is a target exactly once (-1
    fills the last window).
    """
    counts = np.array([-(-(len(s) - 1) // SCORED) for s in sequences])
    sizes = SHARED + SCORED * counts
    ends = np.cumsum(sizes)
    ids = np.full(int(ends[-1]), pad, np.int64)
    targets = np.full(int(SCORED * counts.sum()), -1, np.int64)
    at = 0
    for s, end, size in zip(sequences, ends, sizes):
        start = end - size + SHARED
        ids[start : start + len(s) - 1] = s[:-1]
        targets[at : at + len(s) - 1] = s[1:]
        at += size - SHARED
    owner = np.repeat(np.arange(len(sequences)), counts)
    first = np.cumsum(counts) - counts
    begin = (ends - sizes)[owner] + SCORED * (np.arange(len(owner)) - first[owner])
    return ids[begin[:, None] + np.arange(KEYS)], targets.reshape(-1, SCORED), owner


WEIGHTS = ("vectors", "query", "key", "value", "bias", "out", "out_bias")


@dataclass
class Model:
    vectors: np.ndarray  # (ids + 1, WIDTH); the last one is the padding
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    bias: np.ndarray  # by distance
    out: np.ndarray  # (WIDTH, CLASSES)
    out_bias: np.ndarray
    classes: np.ndarray  # class of every id
    emission: np.ndarray  # log10 share of an id in its class

    @property
    def pad(self) -> int:
        return len(self.vectors) - 1

    def prepare(self) -> Model:
        """The weights as a pass uses them."""
        self.layer = _layer({k: getattr(self, k) for k in WEIGHTS})
        return self

    def log10_probabilities(self, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 P of every target (0 where there is none), by batched masked attention."""
        log10 = np.empty(targets.size, np.float32)
        for at in range(0, len(ids), BLOCK):
            x, known = ids[at : at + BLOCK], np.maximum(targets[at : at + BLOCK].ravel(), 0)
            *_, logits = _forward(self.layer, self.vectors.take(x, axis=0), x[:, 0] == self.pad)
            _within(logits)
            log = logits.ravel().take(np.arange(0, logits.size, CLASSES) + self.classes[known])
            log -= np.log(np.exp(logits, out=logits) @ _ONES[:CLASSES])
            log10[at * SCORED : at * SCORED + len(known)] = log / np.float32(np.log(10)) + self.emission[known]
        return np.where(targets >= 0, log10.reshape(targets.shape), 0)


def places(counts: np.ndarray) -> np.ndarray:
    """Place of every id (and the padding) in a profile: the most frequent ids have one each."""
    size = len(counts)
    place = np.full(size + 1, PROFILE - 1)
    frequent = np.lexsort((np.arange(size), -counts))[: PROFILE - 1]
    place[frequent] = np.arange(len(frequent))
    return place


def neighbours(before: np.ndarray, after: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``id * PROFILE + place of the id before it`` for every pair of real ids."""
    real = (after < len(place) - 1) & (before < len(place) - 1)
    return after[real].astype(np.int64) * PROFILE + place[before[real]]


def word_classes(counts: np.ndarray, ids: np.ndarray, rounds: int = 8, profile: np.ndarray | None = None) -> np.ndarray:
    """Class of every id: frequent ids alone, the others by what stands before them.

    ``counts`` are corpus counts. ``profile`` (ids, PROFILE) counts what stands before each
    id, over the corpus; without it the neighbours in the windows ``ids`` are counted. The
    profiles are clustered by k-means. Ids that occur nowhere share the last class.
    """
    size = len(counts)
    order = np.lexsort((np.arange(size), -counts))
    classes = np.full(size, CLASSES - 1)
    classes[order[:SINGLES]] = np.arange(SINGLES)
    if profile is None:
        keys = neighbours(ids[:, :-1].ravel(), ids[:, 1:].ravel(), places(counts))
        profile = np.bincount(keys, minlength=size * PROFILE).reshape(size, PROFILE).astype(np.float32)
    rest = order[SINGLES:]
    rest = rest[profile[rest].sum(1) > 0]
    groups = CLASSES - SINGLES - 1
    if len(rest) < groups:
        return classes
    points = np.sqrt(profile[rest] / profile[rest].sum(1, keepdims=True))
    centres = points[:groups].copy()  # the most frequent of the rest
    for _ in range(rounds):
        nearest = (points @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        filled = np.bincount(nearest, minlength=groups)
        centres = np.where(filled[:, None] > 0, sums / np.maximum(filled, 1)[:, None], centres)
    classes[rest] = SINGLES + nearest
    return classes


def train(
    ids: np.ndarray,
    targets: np.ndarray,
    counts: np.ndarray,
    epochs: int = 2,
    batch: int = 512,
    rate: float = 0.01,
    profile: np.ndarray | None = None,
) -> Model:
    """Fit on windows with Adam; corpus ``counts`` and ``profile`` give classes, shares and the start."""
    size = len(counts)
    classes = word_classes(counts, ids, profile=profile)
    smooth = counts + 0.1
    totals = np.bincount(classes, smooth, CLASSES)
    emission = np.log10(smooth / totals[classes]).astype(np.float32)
    start = np.log(np.maximum(totals, 1e-9) / totals.sum())
    draw = np.random.default_rng(7)
    p = {
        "vectors": draw.normal(0, 0.3, (size + 1, WIDTH)),
        "query": draw.normal(0, 0.25, (WIDTH, WIDTH)),
        "key": draw.normal(0, 0.25, (WIDTH, WIDTH)),
        "value": draw.normal(0, 0.25, (WIDTH, WIDTH)),
        "bias": -0.1 * np.arange(KEYS),
        "out": draw.normal(0, 0.1, (WIDTH, CLASSES)),
        "out_bias": start,
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(ids))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            step += 1
            for k, g in gradients(p, ids[rows], targets[rows], classes).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                corrected = (m[k] / (1 - 0.9**step), v[k] / (1 - 0.99**step))
                p[k] -= np.float32(rate) * corrected[0] / (np.sqrt(corrected[1]) + 1e-8)
    return Model(**p, classes=classes, emission=emission)


def continued(model: Model, blocks: Iterable[tuple[np.ndarray, np.ndarray]], batch: int = 512, rate: float = 0.003) -> np.ndarray | None:
    """One pass of Adam over all windows of the blocks, from the model's weights on.

    Gives weighted sums, so that those of several tasks add up (see ``averaged``): vectors
    by how often each id was read, all other weights by windows. None without windows.
    """
    p = {k: getattr(model, k).astype(np.float32) for k in WEIGHTS}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    read, seen, step = np.zeros(len(p["vectors"]), np.float32), 0, 0
    draw = np.random.default_rng(7)
    for ids, targets in blocks:
        read += np.bincount(ids.ravel(), minlength=len(read))
        order = draw.permutation(len(ids))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            step += 1
            seen += len(rows)
            used, found = _gradients(p, ids[rows], targets[rows], model.classes)
            for k, g in found.items():
                on = used if k == "vectors" else slice(None)  # other vectors keep their moments
                m1, m2 = m[k][on], v[k][on]
                m1 += np.float32(0.1) * (g - m1)
                g *= g
                m2 += np.float32(0.01) * (g - m2)
                m[k][on], v[k][on] = m1, m2
                g = np.sqrt(m2 * np.float32(1 / (1 - 0.99**step)))
                g += np.float32(1e-8)
                p[k][on] -= np.float32(rate / (1 - 0.9**step)) * m1 / g
    if not seen:
        return None
    rest = [p[k].ravel() * np.float32(seen) for k in WEIGHTS[1:]]
    return np.concatenate([(p["vectors"] * read[:, None]).ravel(), read, *rest, [seen]]).astype(np.float32)


def averaged(model: Model, sums: np.ndarray) -> Model:
    """The weighted mean of continued models; vectors of ids that none has read stay."""
    cut = np.split(sums.astype(np.float64), np.cumsum([model.vectors.size, len(model.vectors), *[getattr(model, k).size for k in WEIGHTS[1:]]]))
    vectors, read = cut[0].reshape(model.vectors.shape), cut[1][:, None]
    found = {"vectors": np.where(read > 0, vectors / np.maximum(read, 1), model.vectors)}
    found |= {k: (x / cut[-1]).reshape(getattr(model, k).shape) for k, x in zip(WEIGHTS[1:], cut[2:])}
    return Model(**{k: x.astype(np.float32) for k, x in found.items()}, classes=model.classes, emission=model.emission)


def gradients(p: dict, ids: np.ndarray, targets: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log probability of the targets' classes."""
    used, found = _gradients(p, ids, targets, classes)
    vectors = np.zeros_like(p["vectors"])
    vectors[used] = found["vectors"]
    return found | {"vectors": vectors}


def _layer(p: dict) -> tuple[np.ndarray, ...]:
    """Query and key as one matrix, value, classes with their bias as a last row, bias by place."""
    both = p["query"] @ p["key"].T / np.float32(np.sqrt(WIDTH))
    return both, p["value"], np.vstack([p["out"], p["out_bias"]]), p["bias"][_FAR] + _CAUSAL


def _within(x: np.ndarray) -> None:
    """Shift rows to a top of 0 if any exponential could leave the range of 32 bits."""
    if x.max() > 30 or x.min() < -80:
        x -= x.max(-1, keepdims=True)


def _forward(layer: tuple[np.ndarray, ...], e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """From the vectors read by some windows to class logits, with all that lies between.

    ``first`` marks the windows that open a sequence: their shared places are padding. The
    attention ``a`` is not normalised, the places it gathers (``c``) are, by ``part``.
    """
    both, value, out, near = layer
    last = e[:, SHARED:].reshape(-1, WIDTH)
    q = (last @ both).reshape(-1, SCORED, WIDTH)
    a = q @ e.transpose(0, 2, 1)
    a += near
    first = np.flatnonzero(first)
    if len(first):
        a[first, :, :SHARED] -= 30
    _within(a)
    np.exp(a, out=a)
    part = 1 / (a @ _ONES[:KEYS]).reshape(-1, 1)
    c = (a @ e).reshape(-1, WIDTH)
    c *= part
    h = np.empty((len(last), WIDTH + 1), np.float32)
    np.add(c @ value, last, out=h[:, :WIDTH])
    h[:, WIDTH] = 1
    return last, q, a, part, c, h, h @ out


def _gradients(p: dict, ids: np.ndarray, targets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The ids read, and the gradients, of ``vectors`` for those ids only."""
    pad, layer = len(p["vectors"]) - 1, _layer(p)
    both, value, out, _ = layer
    used = np.flatnonzero(np.bincount(ids.ravel(), minlength=pad + 1) > 0)
    place = np.empty(pad + 1, np.int64)
    place[used] = np.arange(len(used))
    own, read = place[ids], p["vectors"][used]
    share = np.float32(1 / max(np.count_nonzero(targets >= 0), 1))
    de = np.empty((len(ids), KEYS, WIDTH), np.float32)
    d_both, d_value, d_out, d_near = (np.zeros_like(x) for x in layer)
    for at in range(0, len(ids), BLOCK):
        block = slice(at, at + BLOCK)
        e, t = read.take(own[block], axis=0), targets[block].ravel()
        last, q, a, part, c, h, z = _forward(layer, e, ids[block, 0] == pad)
        _within(z)
        np.exp(z, out=z)
        real = (t >= 0) * share
        z *= (real / (z @ _ONES[:CLASSES]))[:, None]
        z.ravel()[np.arange(0, z.size, CLASSES) + classes[t]] -= real
        dh = z @ out[:WIDTH].T
        dc = dh @ value.T
        dc *= part
        minus = ((dc * c) @ _ONES[:WIDTH]).reshape(-1, SCORED, 1)
        dc = dc.reshape(-1, SCORED, WIDTH)
        ds = dc @ e.transpose(0, 2, 1)
        ds -= minus
        ds *= a
        dq = (ds @ e).reshape(-1, WIDTH)
        de[block] = ds.transpose(0, 2, 1) @ q
        de[block] += a.transpose(0, 2, 1) @ dc
        d_both += last.T @ dq
        d_value += c.T @ dh
        d_out += (z.T @ h).T
        d_near += ds.sum(0)
        dh += dq @ both.T
        de[block, SHARED:] += dh.reshape(-1, SCORED, WIDTH)
    vectors = np.zeros(read.shape, np.float32)
    # Rows of one id are added up, two numbers at a time.
    two = (own.ravel() * (WIDTH // 2))[:, None] + np.arange(WIDTH // 2)
    np.add.at(vectors.ravel().view(np.complex64), two.ravel(), de.ravel().view(np.complex64))
    d_both /= np.float32(np.sqrt(WIDTH))
    return used, {
        "vectors": vectors,
        "query": d_both @ p["key"],
        "key": d_both.T @ p["query"],
        "value": d_value,
        "bias": np.bincount(_FAR.ravel(), np.where(_DISTANCE >= 0, d_near, 0).ravel(), KEYS).astype(np.float32),
        "out": d_out[:WIDTH],
        "out_bias": d_out[WIDTH],
    }

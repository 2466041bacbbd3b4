"""Removal of repeated byte strings: anchors bring the candidates together, a run-length
Burrows-Wheeler index decides.

Of every ``LENGTH`` consecutive bytes the ``ANCHOR``-byte string with the smallest hash is the
anchor (the leftmost one of equals). Equal strings of ``LENGTH`` bytes have equal anchors at
the same place, so only strings with a common anchor need to be compared; no match is lost.

1. Tasks note each anchor with a hash of all bytes around it that can belong to such a string
   (its *frame*, up to 84 bytes) and of the *cores*: the 39 or 40 bytes that all strings of a third
   of the frame have in common. Entries are exchanged by anchor in packed blocks. Copies of a
   frame within a task are settled at once: all but the smallest document's are repeats.
2. For every anchor: frames that a smaller document has as well are settled; of different
   frames of an anchor, those are asked for that have a core in common with another document's.
3. The frames asked for are cut from the texts, as far as such cores reach, and exchanged by
   anchor in packed blocks. The parts of a block's frames that may be shared (by hash) get a
   run-length index, copies once, through which they are streamed: the index decides. A very
   frequent anchor with many different frames is dealt by its cores, and a very frequent core by
   its single strings instead, so that no block grows with it.
4. The settled ranges are joined with the texts, which are exchanged once for both joins.

Cases: null and empty texts keep nothing and lose nothing; rows with a null doc_id neither
lose bytes nor count as earlier documents; repeated rows of one id are one document, each row
judged by itself; texts under 50 bytes lose nothing; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.llm.common import slices, utf8
from railguard.llm.runindex import RunLengthIndex
from railguard.session import durable

LENGTH = 50
ANCHOR = 16
SPREAD = LENGTH - ANCHOR  # bytes on each side of an anchor that a string can reach
#: Bytes of text of a group of documents, anchors of a block, bytes of frames of a block.
GROUP_BYTES = 8 << 20
BLOCK_ANCHORS = 1 << 20
BLOCK_BYTES = 1 << 20
#: Anchors and documents that a task packs at a time.
HELD_ANCHORS, HELD_DOCS = 1 << 21, 60_000
#: An anchor with more different frames than this is dealt by its cores, such a core by its strings.
HOT_FRAMES = 5000
#: Bytes of documents laid side by side, and windows looked at in one step (small enough for a cache).
SIDE_BYTES, TILE = 1 << 20, 1 << 15

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: The place within a tile takes 24 bits of an anchor's key.
_PLACE = np.uint64(24)
#: A fixed number per byte, and one (the last) for what is outside a text.
_LETTERS = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 64, 257, dtype=np.uint64)
_FACTOR = 0xD6E8FEB86659FD93
_ODD = np.random.Generator(np.random.PCG64(10)).integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
#: ``ANCHOR``-byte strings, by their distance from the anchor, that make up a frame and, with the
#: anchor, each core; strings of a frame that have the core: from which on, and before which.
_FRAME = (-34, -18, -2, 14, 30, 34)
_CORES = ((-23, -16), (-12, 12), (16, 23))
_THIRDS = ((0, 12), (12, 23), (23, 35))
#: Bytes of a packed entry: anchor, frame, cores, position, document.
_WIDTHS = (5, 6, 3, 3, 3, 4, 2)

_SETTLED = np.dtype([("rid", "<i8"), ("place", "<u4")])
#: ``thirds``: a bit for every third asked for, and ``_SINGLE``.
_ASKED = np.dtype([("rid", "<i8"), ("place", "<u4"), ("key", "<i8"), ("thirds", "u1")])
_SINGLE = 1 << len(_THIRDS)
_RANGE = np.dtype([("rid", "<i8"), ("start", "<u4"), ("stop", "<u4")])


def _mixed(h: np.ndarray) -> np.ndarray:
    """``h`` itself, stirred."""
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def string_hashes(data: np.ndarray, length: int, outside: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from every position on; ``outside`` has the positions
    that belong to no text."""
    h = _LETTERS[data]
    if outside is not None:
        h[outside] = _LETTERS[256]
    size = 1
    while size < length:  # of up to twice the length, from those of two parts that may overlap
        step = min(size, length - size)
        h = h[:-step] * np.uint64(pow(_FACTOR, step, 1 << 64)) + h[step:]
        size += step
    return _mixed(h)


def _combined(*keys: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several columns."""
    h = np.full(len(keys[0]), _MIX[2])
    for key, odd in zip(keys, _ODD):
        h += key.astype(np.uint64, copy=False) * odd
    return _mixed(h)


def together(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows of the columns together, and where a new one begins."""
    n = len(keys[0])
    bits = np.uint64(max(1, n - 1).bit_length())
    packed = _combined(*keys) >> bits << bits
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    packed >>= bits

    def begins() -> np.ndarray:
        fresh = np.zeros(n, bool)
        fresh[:1] = True
        for key in keys:
            own = key[order]
            fresh[1:] |= own[1:] != own[:-1]
        return fresh

    fresh = begins()
    if (fresh[1:] & (packed[1:] == packed[:-1])).any():  # different rows, equal in what is left of the hash
        order = np.lexsort(keys)
        fresh = begins()
    return order, fresh


def _split(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group (a number from 0 on) with its rows, in their order."""
    if len(group):
        bits = max(1, len(group) - 1).bit_length()
        packed = group.astype(np.uint64) << np.uint64(bits) | np.arange(len(group), dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        packed >>= np.uint64(bits)
        cuts = np.flatnonzero(packed[1:] != packed[:-1]) + 1
        for rows in np.split(order, cuts):
            yield int(group[rows[0]]), rows


def _least(data: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a tile: all hashes, anchors (places in the tile) and the first and last window of each."""
    h = string_hashes(data, ANCHOR, outside)
    own = h[SPREAD : 2 * SPREAD + TILE]
    least, size, width = own >> _PLACE << _PLACE, 1, SPREAD + 1
    if len(own) < width:
        none = np.empty(0, np.int64)
        return h, none, none, none
    least |= np.arange(len(own), dtype=np.uint64)
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - width + size], least[width - size :])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    return h, (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64), first, last


def entries(texts: list[bytes]) -> list[np.ndarray]:
    """Anchor (40 bits of its hash), frame (48 bits), cores (24 bits each), place and number of the
    text, of all anchors of some texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = bytes(SPREAD)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    stops = np.cumsum(sizes + SPREAD)
    starts = stops - sizes
    outside = (np.r_[0, stops][:, None] + np.arange(SPREAD)).ravel()
    found: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] * 5 + [np.empty(0, np.int64)] * 2]
    for at in range(SPREAD, int(stops[-1]) if len(texts) else 0, TILE):
        base, end = at - SPREAD, min(at + TILE + SPREAD + LENGTH, len(data))
        lo, hi = np.searchsorted(outside, (base, end))
        h, place, first, last = _least(data[base:end], outside[lo:hi] - base)
        text = np.searchsorted(starts, place + at, "right") - 1
        # A window counts if it is inside of a text; gaps have anchors too.
        text = np.maximum(text, 0)
        counts = np.maximum(first + at, starts[text]) <= np.minimum(last + at, stops[text] - LENGTH)
        place, text = place[counts], text[counts]
        own = place + SPREAD
        anchor = h[own]
        frame = _combined(*(h[own + x] for x in _FRAME)) >> np.uint64(16)
        cores = [_combined(*(h[own + x] for x in core)) >> np.uint64(40) for core in _CORES]
        found.append([anchor >> _PLACE, frame, *cores, place + at - starts[text], text])
    out = [np.concatenate(x) for x in zip(*found)]
    fresh = np.ones(len(out[0]), bool)  # the last anchor of a tile may be the first of the next
    fresh[1:] = (out[5][1:] != out[5][:-1]) | (out[6][1:] != out[6][:-1])
    return [x[fresh] for x in out]


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (40 bits) and positions of all anchors of a text."""
    found = entries([text])
    return found[0], found[5]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Byte by byte: all first bytes of a column, then all second ones, which compresses well."""
    out = np.empty((sum(_WIDTHS), len(columns[0])), np.uint8)
    at = 0
    for width, values in zip(_WIDTHS, columns):
        wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(width):
            out[at + k] = wide[:, k]
        at += width
    return out.tobytes()


def _unpack(packed: bytes) -> list[np.ndarray]:
    rows = np.frombuffer(packed, np.uint8).reshape(sum(_WIDTHS), -1)
    out, at = [], 0
    for width in _WIDTHS:
        wide = np.zeros((rows.shape[1], 8), np.uint8)
        for k in range(width):
            wide[:, k] = rows[at + k]
        out.append(wide.view("<u8").ravel())
        at += width
    return out


def _settle(anchor, frame, doc) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose frame a smaller document has too, and one other entry of every frame."""
    order, fresh = together(anchor, frame)
    starts = np.flatnonzero(fresh)
    repeat, lead = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    if len(starts):
        of = doc[order]
        later = of > np.repeat(np.minimum.reduceat(of, starts), np.diff(np.r_[starts, len(of)]))
        repeat[order] = later
        lead[order[np.minimum.reduceat(np.where(later, len(of), np.arange(len(of))), starts)]] = True
    return repeat, lead


_BLOCKS = "block bigint, entries binary, ids array<bigint>, rids array<bigint>, settled binary"


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


def _records(kind: np.dtype, *columns) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for name, values in zip(kind.names, columns):
        out[name] = values
    return out


def _note(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Anchor entries of a task's documents in packed blocks, settled ranges along with them."""
    held: list[list[np.ndarray]] = []
    ids: list[int] = []
    rids: list[int] = []
    texts: list[bytes] = []
    size = beside = 0

    def note() -> None:
        nonlocal size, beside, texts
        if texts:
            found = entries(texts)
            found[6] = found[6] + (len(ids) - len(texts))
            held.append(found)
            size += len(found[0])
            texts, beside = [], 0

    def done() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        anchor, frame, place, doc = (columns[k] for k in (0, 1, 5, 6))
        id_of, rid_of = np.array(ids, np.int64), np.array(rids, np.int64)
        repeat, _ = _settle(anchor, frame, id_of[doc])
        out: dict[str, list] = {k: [] for k in ("block", "entries", "ids", "rids", "settled")}
        for block, rows in _split((anchor % np.uint64(blocks)).astype(np.int64)):
            kept, gone = rows[~repeat[rows]], rows[repeat[rows]]
            of = doc[kept]  # rises
            fresh = np.ones(len(of), bool)
            fresh[1:] = of[1:] != of[:-1]
            known = of[fresh]
            out["block"].append(block)
            out["entries"].append(_pack([*(c[kept] for c in columns[:6]), np.cumsum(fresh) - 1]))
            out["ids"].append(id_of[known])
            out["rids"].append(rid_of[known])
            out["settled"].append(_records(_SETTLED, rid_of[doc[gone]], place[gone]).tobytes())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(out["block"], pa.int64()),
                pa.array(out["entries"], pa.binary()),
                _lists(out["ids"]),
                _lists(out["rids"]),
                pa.array(out["settled"], pa.binary()),
            ],
            names=list(out),
        )

    for part in slices(batches):
        for doc_id, rid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2))):
            ids.append(doc_id)
            rids.append(rid)
            texts.append(text)
            beside += len(text)
            if beside >= SIDE_BYTES or len(ids) >= HELD_DOCS:
                note()
            if size >= HELD_ANCHORS or len(ids) >= HELD_DOCS:
                note()
                if size:
                    yield done()
                held, ids, rids, size = [], [], [], 0
    note()
    if size:
        yield done()


_FOUND = "group bigint, settled binary, asked binary"


def _ask(anchor, frame, cores, place, doc, rid, hot_frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries of some anchors: those settled, and those whose frame is asked for."""
    order, fresh = together(anchor)
    rows = order[~(fresh & np.r_[fresh[1:], True][: len(fresh)])]  # an anchor that occurs once can be left out
    anchor, frame, place, doc, rid = (x[rows] for x in (anchor, frame, place, doc, rid))
    repeat, lead = _settle(anchor, frame, doc)
    settled = _records(_SETTLED, rid[repeat], place[repeat])
    first = np.flatnonzero(~repeat)
    anchor, place, doc, rid, lead = (x[first] for x in (anchor, place, doc, rid, lead))
    cores = [core[rows[first]] for core in cores]
    thirds, hot_cores = np.zeros(len(first), np.uint8), []
    for k, core in enumerate(cores):
        order, fresh = together(anchor, core)
        starts = np.flatnonzero(fresh)
        hot = np.zeros(len(first), bool)
        if len(starts):
            sizes = np.diff(np.r_[starts, len(first)])
            kinds = np.add.reduceat(lead[order].astype(np.int64), starts)
            of = doc[order]
            apart = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
            thirds[order] |= np.repeat((kinds > 1) & apart, sizes).astype(np.uint8) << np.uint8(k)
            hot[order] = np.repeat(kinds > hot_frames, sizes)
        hot_cores.append(hot)
    at = np.flatnonzero(thirds)
    order, fresh = together(anchor[at])
    starts = np.flatnonzero(fresh)
    hot = np.zeros(len(at), bool)
    if len(starts):
        kinds = np.add.reduceat(lead[at[order]].astype(np.int64), starts)
        hot[order] = np.repeat(kinds > hot_frames, np.diff(np.r_[starts, len(at)]))
    key_bits = np.uint64((1 << 62) - 1)
    plain = at[~hot]
    asked = [_records(_ASKED, rid[plain], place[plain], _combined(anchor[plain]) & key_bits, thirds[plain])]
    for k, (core, hot_core) in enumerate(zip(cores, hot_cores)):
        own = at[hot & (thirds[at] >> np.uint8(k) & 1 > 0)]
        key = _combined(anchor[own], np.full(len(own), k + 1), core[own]) & key_bits
        what = (1 << k) + _SINGLE * hot_core[own]
        asked.append(_records(_ASKED, rid[own], place[own], key, what))
    return settled, np.concatenate(asked)


def _resolve(batches: Iterator[pa.RecordBatch], groups: int, hot_frames: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks, one block after another; what is found by groups of texts."""
    held: list[list[np.ndarray]] = []
    gone: list[bytes] = []
    current = None

    def done() -> pa.RecordBatch:
        before = np.frombuffer(b"".join(gone), _SETTLED)
        settled, asked = before, np.empty(0, _ASKED)
        if held:
            anchor, frame, *cores, place, doc, rid = (np.concatenate(x) for x in zip(*held))
            held.clear()
            settled, asked = _ask(anchor, frame, cores, place, doc, rid, hot_frames)
            settled = np.concatenate([before, settled])
        out: dict[str, list] = {"group": [], "settled": [], "asked": []}
        for name, found in (("settled", settled), ("asked", asked)):
            for group, rows in _split(found["rid"] % groups):
                out["group"].append(group)
                for column in ("settled", "asked"):
                    out[column].append(found[rows].tobytes() if column == name else None)
        return pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int64() if k == "group" else pa.binary()) for k, v in out.items()], names=list(out)
        )

    for batch in batches:
        blocks, packed, settled = (batch.column(k).to_pylist() for k in (0, 1, 4))
        for i, block in enumerate(blocks):
            ids, rids = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
            if block != current and (held or gone):
                yield done()
                held, gone = [], []
            current = block
            gone.append(settled[i])
            *columns, local = _unpack(packed[i])
            if len(local):
                local = local.astype(np.int64)
                held.append([*columns, ids[local], rids[local]])
    if held or gone:
        yield done()


def shared_parts(contents: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames with a string whose hash another document of the block has too: their places,
    and from where to where such strings reach. The index need not hold anything else."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    first = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(contents)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    data = np.frombuffer(b"".join(contents), np.uint8)
    if not len(owner):
        return owner, offset, offset
    hashes = string_hashes(data, LENGTH)[first[owner] + offset]
    order, fresh = together(hashes)
    starts = np.flatnonzero(fresh)
    of = docs[owner[order]]
    several = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
    shared = np.sort(order[np.repeat(several, np.diff(np.r_[starts, len(order)]))])
    if not len(shared):
        return shared, shared, shared
    edge = np.flatnonzero(np.r_[True, owner[shared][1:] != owner[shared][:-1]])
    last = np.r_[edge[1:], len(shared)] - 1
    return owner[shared[edge]], offset[shared[edge]], offset[shared[last]] + LENGTH


class _Texts:
    """The texts of a group as one array of bytes, found by row id (rows of one id are equal)."""

    def __init__(self, texts: pa.Table):
        column = texts["text"].cast(pa.large_binary()).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        n, (_, offsets, data) = len(column), column.buffers()
        self.data = memoryview(data if data is not None else b"")
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        self.sizes = np.diff(self.offsets)
        self.rids = texts["rid"].to_numpy()
        self._order = np.argsort(self.rids, kind="stable")
        self._sorted = self.rids[self._order]

    def row(self, rids: np.ndarray) -> np.ndarray:
        """The first row of each id."""
        return self._order[np.searchsorted(self._sorted, rids)]


_PIECES = "block bigint, docs array<bigint>, rids array<bigint>, starts array<bigint>, sizes array<bigint>, content binary"
_RANGES = "group bigint, ranges binary"


def _cut_frames(blocks: int):
    """The frames asked for, cut from a group of texts; single strings of hot cores. Without
    content: strings that a smaller document of the group has."""
    low = np.array([min([a for k, (a, _) in enumerate(_THIRDS) if m >> k & 1], default=0) for m in range(_SINGLE)])
    high = np.array([max([b for k, (_, b) in enumerate(_THIRDS) if m >> k & 1], default=0) for m in range(_SINGLE)])

    def cut(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("block", "docs", "rids", "starts", "sizes", "content")}

        def add(block, doc, rid, start, stop, content):
            for k, v in zip(out, (block, doc, rid, start, stop - start, content)):
                out[k].append(v)

        wanted = np.frombuffer(b"".join(asked["asked"].to_pylist()), _ASKED)
        if len(wanted):
            source = _Texts(texts)
            row, thirds = source.row(wanted["rid"]), wanted["thirds"] % _SINGLE
            begin = wanted["place"].astype(np.int64) - SPREAD
            start = np.maximum(begin + low[thirds], 0)
            stop = np.minimum(begin + high[thirds] + LENGTH - 1, source.sizes[row])
            # Rows without an id are not asked for; with nulls the ids would become floats.
            doc, rid, base = texts["doc_id"].fill_null(0).to_numpy()[row], wanted["rid"], source.offsets[row]
            able, single = stop - start >= LENGTH, wanted["thirds"] >= _SINGLE

            def read(rows):
                return [source.data[a:b] for a, b in zip((base + start)[rows].tolist(), (base + stop)[rows].tolist())]

            whole = np.flatnonzero(able & ~single)
            for block, rows in _split(wanted["key"][whole] % blocks):
                rows = whole[rows]
                add(block, doc[rows], rid[rows], start[rows], stop[rows], b"".join(read(rows)))
            singles: dict[bytes, list] = {}
            hot = np.flatnonzero(able & single)
            for frame, *place in zip(read(hot), *(x[hot].tolist() for x in (doc, rid, start))):
                frame = bytes(frame)
                for i in range(len(frame) - LENGTH + 1):
                    singles.setdefault(frame[i : i + LENGTH], []).append((*place[:2], place[2] + i))
            # The smallest document of the group stands for the others, which are settled here.
            kept, gone, contents = [], [], []
            for content, places in singles.items():
                least = min(places)[0]
                for place in places:
                    if place[0] == least:
                        kept.append(place)
                        contents.append(content)
                    else:
                        gone.append(place)
            if kept:
                places = np.array(kept, np.int64)
                keys = np.fromiter(map(xxhash.xxh3_64_intdigest, contents), np.uint64, len(contents))
                for block, rows in _split((keys % np.uint64(blocks)).astype(np.int64)):
                    d, r, a = places[rows].T
                    add(block, d, r, a, a + LENGTH, b"".join(contents[i] for i in rows.tolist()))
            if gone:
                d, r, a = np.array(gone, np.int64).T
                add(int(r[0]) % blocks, d, r, a, a + LENGTH, None)
        return pa.table(
            {
                "block": pa.array(out["block"], pa.int64()),
                **{k: _lists(out[k]) for k in ("docs", "rids", "starts", "sizes")},
                "content": pa.array(out["content"], pa.binary()),
            }
        )

    return cut


def _decided(contents: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the contents (number, from, to) that a smaller document's has too, by the index
    of what may be shared. Equal parts are indexed once, for their smallest document."""
    kept, begin, end = shared_parts(contents, docs)
    number: dict[bytes, int] = {}
    part = np.fromiter(
        (number.setdefault(contents[k][b:e], len(number)) for k, b, e in zip(kept.tolist(), begin.tolist(), end.tolist())),
        np.int64,
        len(kept),
    )
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, part, docs[kept])
    repeat = docs[kept] > least[part]
    found = [(kept[repeat], begin[repeat], end[repeat])]
    if number:
        text, offset = RunLengthIndex(list(number), least, LENGTH).matched()
        order = np.lexsort((offset, text))
        text, offset = text[order], offset[order]
        fresh = np.ones(len(text), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (offset[1:] > offset[:-1] + LENGTH)
        first, last = np.flatnonzero(fresh), np.flatnonzero(np.r_[fresh[1:], True][: len(text)])
        text, start, stop = text[first], offset[first], offset[last] + LENGTH
        # The ranges of a part hold for every copy of it in its smallest document.
        own = np.flatnonzero(~repeat)
        own = own[np.argsort(part[own], kind="stable")]
        lo, hi = np.searchsorted(part[own], text, "left"), np.searchsorted(part[own], text, "right")
        which = np.repeat(np.arange(len(text)), hi - lo)
        copy = own[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]]
        found.append((kept[copy], begin[copy] + start[which], begin[copy] + stop[which]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _match(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Ranges that a smaller document has too, by the index of each block."""
    held: list[list[np.ndarray]] = []
    contents: list[bytes] = []
    current = None

    def ranges(rid, start, stop) -> pa.RecordBatch:
        found = _records(_RANGE, rid, start, stop)
        out = [(group, found[rows].tobytes()) for group, rows in _split(found["rid"] % groups)]
        return pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in out], pa.int64()), pa.array([r for _, r in out], pa.binary())], names=["group", "ranges"]
        )

    def done() -> pa.RecordBatch:
        doc, rid, start = (np.concatenate(x) for x in zip(*held))
        which, begin, end = _decided(contents, doc)
        return ranges(rid[which], start[which] + begin, start[which] + end)

    for batch in batches:
        blocks, content = batch.column(0).to_pylist(), batch.column(5).to_pylist()
        for i, block in enumerate(blocks):
            doc, rid, start, size = (batch.column(k)[i].values.to_numpy() for k in range(1, 5))
            if content[i] is None:
                yield ranges(rid, start, start + size)
                continue
            if block != current and held:
                yield done()
                held, contents = [], []
            current = block
            held.append([doc, rid, start])
            stop = np.cumsum(size)
            contents += [content[i][a:b] for a, b in zip((stop - size).tolist(), stop.tolist())]
    if held:
        yield done()


def _remove(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Digest of every row of a group, without the bytes of its settled ranges."""
    source = _Texts(texts)
    settled, ranges = (
        np.frombuffer(b"".join(found[k].drop_null().to_pylist()), kind) for k, kind in (("settled", _SETTLED), ("ranges", _RANGE))
    )
    row = source.row(np.concatenate([settled["rid"], ranges["rid"]]))
    place = settled["place"].astype(np.int64)
    start = np.concatenate([np.maximum(place - SPREAD, 0), ranges["start"].astype(np.int64)])
    stop = np.concatenate([place + LENGTH, ranges["stop"].astype(np.int64)])
    # Places in all texts one after another, a byte between them so that none touch.
    base = source.offsets[:-1] + np.arange(len(source.sizes))
    start, stop = base[row] + start, base[row] + np.minimum(stop, source.sizes[row])
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > stop[:-1]
    start, stop = start[fresh], stop[np.r_[fresh[1:], True][: len(stop)]]
    same = source.row(source.rids)
    lo = np.searchsorted(start, base[same])
    hi = np.searchsorted(start, base[same] + source.sizes[same], "right")
    removed = np.r_[0, np.cumsum(stop - start)]
    kept_sha256 = []
    start, stop = start.tolist(), stop.tolist()
    for shift, at, size, a, b in zip(same.tolist(), base[same].tolist(), source.sizes.tolist(), lo.tolist(), hi.tolist()):
        digest, end = hashlib.sha256(), at + size
        for x, y in zip(start[a:b], stop[a:b]):
            digest.update(source.data[at - shift : x - shift])
            at = y
        digest.update(source.data[at - shift : end - shift])
        kept_sha256.append(digest.hexdigest())
    return pa.table(
        {
            "doc_id": texts["doc_id"].cast(pa.int64()),
            "n_bytes": pa.array(source.sizes),
            "n_removed": pa.array(removed[hi] - removed[lo]),
            "n_spans": pa.array(hi - lo),
            "kept_sha256": pa.array(kept_sha256, pa.string()),
        }
    )


def repeated_strings(docs: DataFrame, hot_frames: int = HOT_FRAMES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    text = F.col("text").cast("string")
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    groups = size // GROUP_BYTES + 1
    blocks = size // (16 * BLOCK_ANCHORS) + 1  # an anchor for about 20 bytes
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn(
        "rid", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    )
    able = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc_id", "rid", "text")
    noted = able.mapInArrow(lambda b: _note(b, blocks), _BLOCKS)
    dealt = noted.repartition("block").sortWithinPartitions("block")
    found = durable(dealt.mapInArrow(lambda b: _resolve(b, groups, hot_frames), _FOUND))
    texts = rows.withColumn("group", F.pmod("rid", F.lit(groups))).groupBy("group")
    asked = found.filter("asked IS NOT NULL").select("group", "asked")
    frames = (asked.select(F.sum(F.octet_length("asked"))).first()[0] or 0) // _ASKED.itemsize
    pieces = frames * (LENGTH + SPREAD) // BLOCK_BYTES + 1
    cut = texts.cogroup(asked.groupBy("group")).applyInArrow(_cut_frames(pieces), _PIECES)
    matched = cut.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _match(b, groups), _RANGES)
    none = F.lit(None).cast("binary")
    settled = found.filter("settled IS NOT NULL").select("group", "settled", none.alias("ranges"))
    every = settled.unionByName(matched.select("group", none.alias("settled"), "ranges"))
    return texts.cogroup(every.groupBy("group")).applyInArrow(
        _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))

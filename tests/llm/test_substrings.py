import hashlib
import random
from collections import Counter

import cases
import numpy as np
import pytest

from railguard.llm.runindex import RunLengthIndex
from railguard.llm import substrings
from railguard.llm.substrings import anchors, repeated_strings, shared_parts


def brute(rows):
    """Expected digest of each row: bytes in 50-byte strings of documents with smaller ids."""
    first = {}
    for doc, text in rows:
        if doc is not None:
            b = (text or "").encode()
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        if doc is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < doc:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [5000, 1])
def test_against_brute_force(spark, hot):
    rows = cases.texts()
    rows += [(100 + i, cases.prose(2, 60)[i * 20 : i * 20 + 49 + i] + cases.prose(40 + i, 12)) for i in range(12)]
    rows += [(200, "a" * 300), (201, "a" * 49), (202, "a" * 50), (203, "é" * 100), (0, "b" * 60 + "a" * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = repeated_strings(docs, hot_frames=hot).collect()
    assert sorted(str(tuple(r)) for r in found) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert repeated_strings(cases.empty(spark)).count() == 0
    assert repeated_strings(cases.documents(spark)).count() == len(cases.texts())


def test_equal_strings_have_equal_anchors():
    draw = random.Random(1)
    shared = bytes(draw.randrange(97, 105) for _ in range(50))
    for _ in range(20):
        texts = [bytes(draw.randrange(97, 105) for _ in range(draw.randrange(80))) for _ in range(4)]
        found = []
        for before, after in (texts[:2], texts[2:]):
            h, p = anchors(before + shared + after)
            found.append({(x, y - len(before)) for x, y in zip(h.tolist(), p.tolist()) if 0 <= y - len(before) <= 34})
        assert found[0] & found[1]


def test_run_length_index_steps_and_matches():
    draw = random.Random(3)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(0, 40))) for _ in range(30)] + [b"abab" * 9] * 3
    docs = np.array([draw.randrange(10) for _ in texts])
    index = RunLengthIndex(texts, docs, 8)
    assert len(index.run_starts) < sum(map(len, texts)) + len(texts)
    for i, t in enumerate(texts):  # backward steps read every text from its last byte
        at, read = np.array([i]), []
        for _ in t:
            symbol, at = index.step(at)
            read.append(int(symbol[0]) - 1)
        assert bytes(reversed(read)) == t
    expected = {
        (i, k)
        for i, t in enumerate(texts)
        for k in range(len(t) - 7)
        if any(t[k : k + 8] in u and docs[j] < docs[i] for j, u in enumerate(texts))
    }
    text, offset = index.matched()
    assert set(zip(text.tolist(), offset.tolist())) == expected


def test_trimming_keeps_every_shared_string():
    draw = random.Random(8)
    passage = bytes(draw.randrange(97, 120) for _ in range(70))
    frames = [bytes(draw.randrange(97, 120) for _ in range(84)) for _ in range(6)]
    frames += [frames[0][:10] + passage[:60], passage[5:] + frames[1][:19], b"z" * 50, b"z" * 84]
    docs = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 9])
    where, start, stop = shared_parts(frames, docs)
    assert where.tolist() == [6, 7] and start.tolist() == [15, 0] and stop.tolist() == [70, 55]


def test_run_end_samples_are_text_positions():
    index = RunLengthIndex([b"banana", b"bananas"], np.array([1, 2]), 7)
    assert len(index.run_end_samples) == len(index.run_starts)
    assert set(index.run_end_samples.tolist()) <= set(range(15))


def passages(seed):
    """Texts that share passages in many surroundings, lines within a text and whole copies."""
    draw = random.Random(seed)

    def prose(n):
        return "".join(draw.choice("abcdefghij ") for _ in range(n))

    shared = [prose(n) for n in (52, 60, 84, 130, 300)]
    texts = []
    for i in range(120):
        text = prose(draw.randrange(120))
        for _ in range(draw.randrange(4)):
            text += draw.choice(shared) * draw.choice((1, 1, 2)) + prose(draw.randrange(60))
        texts.append(text)
    for i in range(0, 40, 3):  # copies with a changed place, and whole ones
        texts += [texts[i][:70] + "#" + texts[i][70:], texts[i]]
    texts += [prose(substrings.TILE - 100) + shared[3] + prose(90) + shared[4], "é" + texts[5]]
    ids = draw.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("hot", [5000, 12, 3])
def test_passages_in_many_surroundings(spark, hot):
    rows = passages(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(str(tuple(r)) for r in repeated_strings(docs, hot_frames=hot).collect()) == brute(rows)


@pytest.mark.parametrize("hot", [5000, 1])
def test_large_ids_beside_rows_without_one(spark, hot):
    shared = cases.prose(61, 20)[:70]
    rows = [(2**60 + k, cases.prose(62 + k, 9) + shared + cases.prose(72 + k, 9)) for k in range(4)]
    rows += [(None, cases.prose(90, 30)), (None, None), (-(2**61) - 1, None), (-(2**61), shared[:60] + "#")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert sorted(str(tuple(r)) for r in repeated_strings(docs, hot_frames=hot).collect()) == brute(rows)


def asked(texts, hot):
    ids = np.arange(len(texts))
    anchor, frame, *cores, place, text = substrings.entries(texts)
    _, found = substrings._ask(anchor, frame, cores, place, ids[text], ids[text], hot)
    return found


def test_common_anchors_alone_ask_for_nothing():
    draw = random.Random(5)

    def noise(n):
        return bytes(draw.randrange(97, 123) for _ in range(n))

    phrase = noise(34)  # all texts have it, and no 50 bytes in common
    texts = [noise(60) + phrase + noise(60) for _ in range(300)]
    often = Counter(a for t in texts for a in anchors(t)[0].tolist())
    assert often.most_common(1)[0][1] > 50
    assert not len(asked(texts, 5000))
    # A passage of 50 bytes is asked for, of frequent anchors only the thirds that share a core.
    passage = noise(50)
    texts = [noise(60) + passage + noise(60) for _ in range(300)]
    few, many = asked(texts, 5000), asked(texts, 1)
    assert set(few["rid"].tolist()) == set(many["rid"].tolist()) == set(range(300))
    assert (few["thirds"] < substrings._SINGLE).all()
    assert set(many["thirds"].tolist()) <= {1 + substrings._SINGLE, 2 + substrings._SINGLE, 4 + substrings._SINGLE}


def test_equal_rows_come_together_whatever_their_hash(monkeypatch):
    draw = np.random.default_rng(6)
    a, b = draw.integers(0, 5, 200).astype(np.uint64), draw.integers(0, 5, 200).astype(np.uint64)
    for combined in (substrings._combined, lambda *keys: np.zeros(len(keys[0]), np.uint64)):
        monkeypatch.setattr(substrings, "_combined", combined)
        order, fresh = substrings.together(a, b)
        assert sorted(order.tolist()) == list(range(200))
        pairs = list(zip(a[order].tolist(), b[order].tolist()))
        assert [p for p, f in zip(pairs, fresh) if f] == list(dict.fromkeys(pairs))
        assert fresh.sum() == len(set(pairs))


def test_suffixes_of_a_large_block_are_in_order():
    draw = np.random.default_rng(7)
    pool = draw.integers(97, 101, 5000).astype(np.uint8).tobytes()
    texts = [pool[k : k + 4000] for k in draw.integers(0, 1000, 530).tolist()]
    data = b"\0".join(texts) + b"\0"
    assert len(data) > 1 << 21
    symbols = np.frombuffer(data, np.uint8).astype(np.int64)
    order, interval = RunLengthIndex._sort(np.where(symbols, symbols + 1, 0), 50)
    assert sorted(order[:530].tolist()) == np.flatnonzero(symbols == 0).tolist()
    for k in draw.integers(530, len(order) - 1, 400).tolist():
        x, y = (data[p : data.index(b"\0", p)] for p in order[k : k + 2].tolist())
        assert x <= y
        if min(len(x), len(y)) >= 50:
            assert (interval[order[k]] == interval[order[k + 1]]) == (x[:50] == y[:50])

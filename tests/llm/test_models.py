import re
import zlib
from collections import Counter
from math import log10

import cases
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from railguard.llm import attention, langid, quality, scoring
from railguard.llm.trees import fit

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fold(doc, n):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % n


# --- quality ---------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(inside),
    ]


def test_counts_against_brute_force(spark):
    labels = spark.createDataFrame([(5, 1), (13, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    for given in (labels, labels.limit(0)):
        rows = quality.judged(spark, cases.documents(spark), given, ["doc_id", "text", "kept"]).collect()
        assert len(rows) == len(cases.texts())
        for r in rows:
            n, _, _, _, repeated = counts = brute_counts(r["row"]["text"])
            assert [r[s] for s in quality.STATS] == counts
            assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
            assert not (r["kept"] and r["base_failed"])
    assert quality.judged(spark, cases.empty(spark), labels, ["doc_id"]).count() == 0


def test_trees_learn_and_stay_monotone():
    draw = np.random.default_rng(1)
    x = draw.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * draw.random(3000)) > 0.7).astype(float)
    forest = fit(x, y, [1, 0, -1], trees=30)
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.93
    grid = np.repeat(draw.random((50, 1, 3)), 40, axis=1)
    for column, sign in ((0, 1), (2, -1)):
        line = grid.copy()
        line[:, :, column] = np.linspace(0, 1, 40)
        p = forest.margin(line.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(p, axis=1) >= -1e-9).all()


def test_quality_separates_labels(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.judged(spark, docs, labels, ["doc_id"]).select("row.doc_id", "kept", "base_failed").join(labels, "doc_id")
    seen = Counter((r["quality"], r["kept"]) for r in rows.collect() if not r["base_failed"])
    assert seen[(1, True)] >= 0.95 * (seen[(1, True)] + seen[(1, False)])
    assert seen[(0, False)] >= 0.8 * (seen[(0, True)] + seen[(0, False)])


# --- language --------------------------------------------------------------------------


def test_bundles_are_sums_of_bound_vectors():
    text = "Ünder the Ice-under".encode()
    packed, counts = langid.trigrams(text)
    assert np.allclose(langid.bundles([text, None])[0], counts @ langid.bound(packed))
    letters = "".join(map(chr, langid.letters(text.decode()).tolist()))
    assert letters == " ünder the ice under "
    a = langid.letter_bits(np.array([97, 98], np.uint64))
    assert 0.35 < (a[0] != a[1]).mean() < 0.65 and (a == langid.letter_bits(np.array([97, 98], np.uint64))).all()


def test_long_texts_are_bundled_in_chunks(monkeypatch):
    text = cases.prose(1, 400).encode()
    whole = langid.bundles([text])
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.allclose(langid.bundles([text]), whole, atol=1e-2)


def test_languages_of_held_out_documents(spark):
    rows = langid.op5_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = rows.collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_cases(spark):
    docs = cases.documents(spark)
    rows = langid.identified(docs, docs.filter("lang IS NOT NULL AND text IS NOT NULL"), ["doc_id", "text"]).collect()
    assert len(rows) == len(cases.texts())
    for r in rows:
        none = not any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in langid.identified(docs, docs.limit(0), ["doc_id"]).collect()} == {"und"}
    assert langid.identified(cases.empty(spark), docs.limit(0), ["doc_id"]).count() == 0


# --- language model --------------------------------------------------------------------


def test_base_score_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TOP_WORDS", 20)
    docs = cases.documents(spark)
    training = docs.filter(F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 <> 0"))
    tokens = lambda t: SPACE.findall((t or "").translate(LOWER)) + ["\n"]
    c = Counter(w for d, t in cases.texts() if fold(d, 10) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = sorted(
        (str(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)))
        for d, t in cases.texts()
    )
    rows = scoring.scored(docs, training).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"]) for r in rows)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected])
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in rows)
    none = scoring.scored(docs.limit(3), docs.limit(0)).collect()
    assert [r["n_known"] for r in none] == [0] * 3
    assert scoring.scored(cases.empty(spark), training).count() == 0


def test_windows_score_each_token_once():
    sequences = [np.arange(n) for n in (2, 16, 17, 18, 90)]
    ids, targets, owner = attention.windows(sequences, 999)
    for i, s in enumerate(sequences):
        own = targets[owner == i].ravel()
        assert own[own >= 0].tolist() == s[1:].tolist()
        for x, y in zip(ids[owner == i], targets[owner == i]):
            for k, t in enumerate(y):
                if t >= 0:  # what stands right before a target is the last key that it sees
                    assert x[attention.SHARED + k] == t - 1


@pytest.fixture(scope="module")
def small():
    draw = np.random.default_rng(2)
    sequences = [np.r_[299, np.cumsum(draw.integers(1, 4, 60)) % 299, 299] for _ in range(80)]
    ids, targets, _ = attention.windows(sequences, 300)
    counts = np.bincount(targets[targets >= 0], minlength=300).astype(float)
    return ids, targets, counts


def test_model_is_a_distribution_and_learns(small):
    ids, targets, counts = small
    model = attention.train(ids, targets, counts, epochs=8, batch=32).prepare()
    total = sum(10 ** model.log10_probabilities(ids[:4], np.full_like(targets[:4], t))[:, 0].astype(float) for t in range(300))
    assert np.allclose(total, 1, atol=1e-3)
    real = targets >= 0
    unigram = np.log10((counts + 0.1) / (counts + 0.1).sum())[targets[real]].mean()
    assert model.log10_probabilities(ids, targets)[real].mean() > unigram + 0.05


def test_gradients_match_differences(small):
    ids, targets, counts = small
    ids, targets = ids[:6], targets[:6]
    classes = attention.word_classes(counts, ids)
    draw = np.random.default_rng(4)
    shape = {"vectors": (301, 16), "query": (16, 16), "key": (16, 16), "value": (16, 16), "bias": 23, "out": (16, 64), "out_bias": 64}
    p = {k: draw.normal(0, 0.3, s) for k, s in shape.items()}

    def loss(q):
        model = attention.Model(**q, classes=classes, emission=np.zeros(300)).prepare()
        return -model.log10_probabilities(ids, targets)[targets >= 0].mean() * np.log(10)

    found = attention.gradients(p, ids, targets, classes)
    for k in p:
        step = draw.normal(0, 1, p[k].shape)
        up, down = ({**p, k: p[k] + s * 1e-2 * step} for s in (1, -1))
        assert np.isclose((loss(up) - loss(down)) / 2e-2, (found[k] * step).sum(), rtol=0.03, atol=2e-3), k


def test_every_training_document_teaches_the_model(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(scoring, "WINDOWS_PER_DOC", 1)
    # The sample has one window; all else comes from the other documents.
    filler = " ".join(f"w{i}" for i in range(60))
    texts = [f"{filler} {i} " + "zebra quartz violin " * 30 for i in range(40)]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    vocabulary = scoring.default_vocabulary()
    sequences = scoring.subword_sequences(training, vocabulary)
    ids = scoring.WordIds(vocabulary)
    own = [ids.sequence(scoring.words_of(t.encode())) for t in texts]
    assert sorted(r["ids"] for r in sequences.collect()) == sorted(x.astype("<u2").tobytes() for x in own)
    counts = np.bincount(np.concatenate([x[1:] for x in own]), minlength=scoring.END_ID + 1).astype(float)
    profile = scoring.profiles(sequences, counts)
    assert profile.sum() == sum(len(x) - 1 for x in own)
    place = attention.places(counts)
    pairs = Counter((int(b), int(place[a])) for x in own for a, b in zip(x[:-1], x[1:]))
    assert all(profile[b, k] == n for (b, k), n in pairs.items()) and (profile > 0).sum() == len(pairs)
    start = scoring._fit(scoring.sample_windows(training, vocabulary), counts, profile)
    assert (start.classes[counts > 0] < attention.CLASSES - 1).all()
    model = scoring.fitted_on_all(start, sequences)
    read = np.unique(np.concatenate([x[:-1] for x in own]))
    assert (model.vectors[read] != start.vectors[read]).any(1).all()
    x, y, _ = attention.windows(own, start.pad)
    before, after = (m.prepare().log10_probabilities(x, y).sum() for m in (start, model))
    assert after > before


def test_documents_are_split_once_for_fit_and_scores(spark, monkeypatch):
    docs = cases.documents(spark)
    teaches = F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 <> 0")
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    apart = scoring.scored(docs, docs.filter(teaches)).select(*columns).collect()
    monkeypatch.setattr(scoring, "subword_sequences", None)  # the ids written for the scores are fitted on
    once = scoring.scored(docs, teaches).select(*columns).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"])
    for a, b in zip(sorted(apart, key=key), sorted(once, key=key), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=0.02)


def test_word_ids_in_one_go_are_those_of_single_words():
    vocabulary = scoring.default_vocabulary()
    encode = scoring.load_encoding(vocabulary).encode_ordinary
    texts = ["a  b x\u0085 y\x1c z\x1f q\u3000 \u3000 \u3000r \u00a0", "don't 's 'll 12,5 \u65e5\u672c \u00fc", "", "w" * 90 + " a"]
    split = [scoring.words_of(t.encode()) for t in texts]
    got = scoring.WordIds(vocabulary).sequences(scoring.Words.of(pa.array(texts)))
    for words, ids in zip(split, got, strict=True):
        own = [i for w in words for i in encode(" " + w.decode())]
        assert np.frombuffer(ids, "<u2").tolist() == [scoring.END_ID, *own, scoring.END_ID]

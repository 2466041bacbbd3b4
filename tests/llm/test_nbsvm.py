import zlib

import cases
import numpy as np
from conftest import SF

from railguard.llm import nbsvm


def test_descent_finds_the_least_loss(monkeypatch):
    monkeypatch.setattr(nbsvm, "EPOCHS", 3000)
    draw = np.random.default_rng(1)
    rows = [np.sort(draw.choice(30, 6, replace=False)) for _ in range(120)]
    values = [draw.normal(size=6) for _ in rows]
    truth = draw.normal(size=30)
    y = np.array([np.sign(truth[r] @ v + 0.3 * draw.normal()) for r, v in zip(rows, values)])
    w = nbsvm.descend(rows, values, y, np.full(120, 0.5), 30)

    def loss(u):
        return 0.5 * u @ u + 0.5 * sum(max(0.0, 1 - t * (u[r] @ v)) for r, v, t in zip(rows, values, y))

    assert all(loss(w) <= loss(w + s * draw.normal(size=30)) + 1e-4 for s in (1e-3, 1e-2, 0.1) for _ in range(20))
    assert (np.sign([w[r] @ v for r, v in zip(rows, values)]) == y).mean() > 0.9


def test_indicators_by_hand():
    grams = nbsvm.Grams()
    one, two = grams(b"red stone red stone red"), grams(b"red stone")
    assert len(grams(None)) == len(grams(b"")) == 0
    assert (np.diff(one) > 0).all() and one.max() < 1 << nbsvm.BITS
    word = nbsvm._hashed(nbsvm._WORDS, np.array([zlib.crc32(b"stone")]))[0]
    assert word in one and word in two and word in grams(b"  STONE\n")
    echo = nbsvm._levels(nbsvm._ECHOES, np.array([1]), np.array([1]), 4)
    assert set(echo) <= set(one) and not set(echo) & set(two)
    assert nbsvm._shape(b"Ab,,") == 27 and nbsvm._shape("é1".encode()) == 5


def test_held_out_quality(spark):
    folder = SF.replace("sf0.001", "sf0.1")
    rows = nbsvm.op12_quality(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").toPandas()
    assert sorted(rows.doc_id) == sorted(docs.doc_id)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(rows.doc_id, rows.held_out))
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert len(good) > 500 and len(bad) > 90
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert (good >= 0.7).mean() > 0.99 and (bad < 0.7).mean() > 0.95


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs = cases.documents(spark)
    ids = [d for d, _ in cases.texts() if d is not None]
    labels = [(d, d % 2) for d in set(ids)] + [(None, 1), (5, None)]
    flipped = [(d, q if d is None or q is None or zlib.crc32(str(d).encode()) % 4 != 2 else 1 - q) for d, q in labels]
    a, b = (
        {(r["row"]["doc_id"], r["row"]["text"]): r["score"]
         for r in nbsvm.scored(spark, docs, spark.createDataFrame(x, "doc_id bigint, quality int"), ["doc_id", "text"]).collect()}
        for x in (labels, flipped)
    )
    assert a == b and len(set(a.values())) > 5


def test_odd_cases(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(5, 1), (5, 1), (13, 1), (4, 1), (99, 0)], "doc_id bigint, quality int")
    rows = nbsvm.scored(spark, docs, labels, docs.columns).collect()
    assert len(rows) == len(cases.texts())
    assert len({r["score"] for r in rows}) == 1 and 0.5 < rows[0]["score"] < 1  # one class only
    rows = nbsvm.scored(spark, docs, labels.limit(0), ["doc_id", "kept"]).collect()
    assert {r["score"] for r in rows} == {0.5} and len(rows) == len(cases.texts())
    both = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(3, 22)], "doc_id bigint, quality int")
    rows = nbsvm.scored(spark, docs, both, ["doc_id", "text"]).collect()
    assert len(rows) == len(cases.texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["row"]["text"]}) == 1
    assert nbsvm.scored(spark, cases.empty(spark), both, ["doc_id"]).count() == 0


def test_joined_labels_give_the_broadcast_scores(spark, monkeypatch):
    docs = cases.documents(spark)
    both = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(3, 22)], "doc_id bigint, quality int")
    broadcast = sorted(r["score"] for r in nbsvm.scored(spark, docs, both, ["doc_id"]).collect())
    monkeypatch.setattr(nbsvm, "BROADCAST_LABELS", 0)
    assert sorted(r["score"] for r in nbsvm.scored(spark, docs, both, ["doc_id"]).collect()) == broadcast

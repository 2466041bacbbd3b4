import cases
from conftest import SF

import corpus_pipeline
from railguard.llm.common import letter_words
from railguard.llm.secrets import base_spans


def test_stages_act_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = {r["item_id"]: letter_words(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        now = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(now) <= set(kept) and len(now) == out.count()
        if name == "decontaminate":
            for d in set(kept) - set(now):
                w = letter_words(kept[d].encode())
                grams = {tuple(w[i : i + 13]) for i in range(len(w))}
                assert any(tuple(b[i : i + 13]) in grams for b in benchmark.values() for i in range(max(1, len(b) - 12)))
        if name == "secret_scan":
            assert set(now) == set(kept) and not any(base_spans(t.encode()) for t in now.values())
        else:
            assert all(now[d] == kept[d] for d in now)
        docs, kept = out, now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(kept)


def test_pipeline_on_odd_documents(spark):
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert docs.count() > 0, name
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0

import hashlib
import random
import re

import cases
import pytest

from railguard.llm.automaton import SuffixAutomaton
from railguard.llm.decontaminate import automata, contamination, cut_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    own, hit, named = words(text), set(), set()
    for item, content in items:
        w = words(content)
        k = min(len(w), 13)
        for j in range(len(w) - k + 1) if w else ():
            for i in range(len(own) - k + 1):
                if own[i : i + k] == w[j : j + k]:
                    hit |= set(range(i, i + k))
                    named.add(item)
    return len(own), hit, named


@pytest.fixture(scope="module")
def items():
    return [(1, cases.ITEM), (2, cases.SHORT_ITEM), (3, None), (4, ""), (5, cases.ITEM), (6, cases.prose(2, 20)), (None, "One")]


def test_against_brute_force(spark, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = contamination(cases.documents(spark), bench).select("row.doc_id", "text", "*").collect()
    assert len(rows) == len(cases.texts())
    for r in rows:
        n, hit, named = brute(r["text"], items)
        ids = sorted(str(i) for i in named if i is not None)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(ids)), r
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= n)


def test_random_streams_match_brute_force():
    draw = random.Random(5)
    for _ in range(60):
        items = [(i, " ".join(draw.choice("ab") for _ in range(draw.randrange(1, 9)))) for i in range(4)]
        automaton = SuffixAutomaton(3).build([(i, [w.encode() for w in t.split()], True) for i, t in items])
        stream = [draw.choice("abc") for _ in range(40)]
        spans, named = automaton.hits([w.encode() for w in stream])
        hit, expected = set(), set()
        for i, t in items:
            w = t.split()
            k = min(3, len(w))
            for j in range(len(w) - k + 1):
                for at in range(len(stream) - k + 1):
                    if stream[at : at + k] == w[j : j + k]:
                        hit |= set(range(at, at + k))
                        expected.add(i)
        assert {p for a, b in spans for p in range(a, b)} == hit and named == expected


def test_blocks_give_the_same(spark, items, monkeypatch):
    import railguard.llm.decontaminate as d

    bench = spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    whole = contamination(cases.documents(spark), bench).drop("row").collect()
    monkeypatch.setattr(d, "automata", lambda b, w: automata(b, w, block_words=16))
    assert automata(bench, 13, 16).count() > 1
    assert sorted(map(str, contamination(cases.documents(spark), bench).drop("row").collect())) == sorted(map(str, whole))


def test_cut_text_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, cases.ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"Before, {cases.ITEM.upper()}! after"), (2, None)], "doc_id bigint, text string")
    rows = {r["row"]["doc_id"]: r["clean_text"] for r in cut_spans(contamination(docs, bench)).collect()}
    assert rows == {1: "Before, ! after", 2: None}
    assert contamination(cases.empty(spark), bench).count() == 0
    assert not any(r["n_hit"] for r in contamination(docs, bench.limit(0)).collect())

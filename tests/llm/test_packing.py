import zlib
from collections import defaultdict

import cases
import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from railguard.llm.packing import default_vocabulary, pack, pack_round, round_start
from railguard.llm.tokens import PartIds, added_tokens, load_encoding

TOKENIZER = Tokenizer.from_file(default_vocabulary())


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_cached_parts_equal_the_tokenizer():
    parts = PartIds(load_encoding(default_vocabulary()))
    odd = ["a  b", " lead", "trail ", "x\ny", "x \n y", "it's we'll I'd", "  x", "a\0b c", "ü ñ 漢字 \U0001f600", "", "...!? ,a"]
    for batch in (odd, [t or "" for _, t in cases.texts()], odd):
        assert [np.frombuffer(x, "<u2").tolist() for x in parts.ids(batch)] == [ids(t) for t in batch]


def own_parts():
    return PartIds(load_encoding(default_vocabulary()), added_tokens(default_vocabulary()))


def test_added_tokens_equal_the_tokenizer():
    end = "<|endoftext|>"
    texts = [end, end * 2, f"a {end} b", f"{end}a", f"a{end}", f" {end} ", f"a  {end}\n{end} b", f"<|{end}|>", "<|endoftext|", "a b"]
    parts = own_parts()
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in parts.ids(texts)] == [ids(t) for t in texts]
    assert ids(f"a {end} b") == [64, 220, 50256, 275]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", " ", "<|endoftext|>", "\n", "<|", "é"]), max_size=12).map("".join), max_size=4))
def test_any_text_with_added_tokens_equals_the_tokenizer(batch):
    SPECIAL[:] = SPECIAL or [own_parts()]
    assert [np.frombuffer(x, "<u2").tolist() for x in SPECIAL[0].ids(batch)] == [ids(t) for t in batch]


SPECIAL: list = []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.\n\t'é1　", max_size=30), max_size=5))
def test_any_text_equals_the_tokenizer(batch):
    parts = PartIds(load_encoding(default_vocabulary())) if not CACHE else CACHE[0]
    CACHE[:] = [parts]
    assert [np.frombuffer(x, "<u2").tolist() for x in parts.ids(batch)] == [ids(t) for t in batch]


CACHE: list = []


def test_pieces_cover_every_id_once(spark):
    docs = cases.documents(spark).repartition(3)
    rows = pack(docs, block_windows=4).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= 1024
    expected = defaultdict(int)
    for d, t in cases.texts():
        expected[(d, len(ids(t)) + 1)] += 1
    for (d, n), pieces in by_doc.items():
        assert sum(r["length"] for r in pieces) == n * expected.pop((d, n))
    assert not expected
    long = next(t for d, t in cases.texts() if d == 12)
    whole = np.array(ids(long) + [0], "<u4")
    for r in by_doc[(12, len(whole))]:
        part = whole[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    assert pack(cases.empty(spark)).count() == 0


def test_rounds_cut_every_queue_without_gaps():
    for tokens, rounds, phase in ((10, 3, 0), (7, 20, 1 << 31), (1000, 7, (1 << 32) - 1), (10**15, 10**7, 12345)):
        assert round_start(0, tokens, rounds, phase) == 0 and round_start(rounds, tokens, rounds, phase) == tokens


def test_windows_keep_the_proportions():
    queues = {"a": [(("a", i), 700) for i in range(60)], "b": [(("b", i), 90) for i in range(200)], "c": [(("c", 0), 12_000)]}
    total = sum(n for q in queues.values() for _, n in q)
    out = pack_round(queues)
    assert sum(take for _, _, take, _, _ in out) == total
    windows = 8  # over any run of windows the shares differ by what a deficit can carry
    for start in range(0, total // 1024 - windows, 9):
        for s, q in queues.items():
            got = sum(take for p, _, take, w, _ in out if p[0] == s and start <= w < start + windows)
            want = windows * 1024 * sum(n for _, n in q) / total
            assert abs(got - want) <= 2 * 1024

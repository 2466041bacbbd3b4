import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest
from conftest import SF

from railguard.llm import trie


def rebuilt(rows):
    """Turns as lists of (role, text); equal turns must be equal rows here."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    members = defaultdict(list)
    full = rebuilt(rows)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []

    def walk(path):
        n = len(members[path])
        leaves, saved = 0, (n - 1) * len(path[-1][1].encode()) if path else 0
        for child in children[path]:
            a, b = walk(child)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = sorted(c for c in members[path] if len(full[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members[path]), len(path), up, n, len(children[path]), leaves, saved, digest))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_rows(seed=1):
    draw = random.Random(seed)
    say = ["hi", "", None, "é ü", "yes", "no"]
    rows = []
    for c in [*range(-13, 45), 10**12, 10**12 + 2, -(2**63), 2**63 - 1]:
        turns = draw.sample([None, *range(-3, 40)], draw.randrange(0, 14))
        rows += [(c, t, draw.choice(["user", None, "a"]), draw.choice(say[: draw.randrange(1, 7)])) for t in turns]
    for c in range(1000, 1040):  # copies of one conversation, some longer
        rows += [(c, t, "user", f"same {t}") for t in range(12 + (c % 3 == 0))]
    rows += [(2000, t, "user", f"long {t // 50}") for t in range(400)]
    rows += [(2001, t, "user", f"long {t // 50}") for t in range(390)]
    rows += [(2002, 1, "u", "twice"), (2002, 1, "u", "twice"), (2003, 5, "u", "x"), (None, 1, "u", "lost"), (2004, 0, "1:u", ":")]
    draw.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("piece,cells,hot", [(trie.PIECE_TURNS, trie.MOST_CELLS, 200), (7, 64, 3), (100, 1024, 10)])
def test_nodes_against_brute_force(spark, monkeypatch, piece, cells, hot):
    monkeypatch.setattr(trie, "HOT_ROWS", hot)
    monkeypatch.setattr(trie, "ID_BITS", 2 if hot < 100 else 12)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], SCHEMA + ", depth int, kind string").repartition(5)
    assert found(trie.conversation_trie(df, piece, cells)) == brute(rows)


def test_matches_sql(spark):
    assert oracle.difference(trie.op11_trie(spark, SF), oracle.duck(SF), trie.OP11_SQL) is None


def test_screening_proves_only_singletons(spark):
    turns, convs = trie.rebuilt(spark.createDataFrame(odd_rows(), SCHEMA))
    rows = trie.durable(trie.prefixes(turns, convs))
    kinds = defaultdict(list)
    for r in trie.screened(rows, 1 << 12).collect():
        kinds[r["p1"], r["p2"], r["depth"]].append(r["kind"])
    assert all(len(k) == 1 for k in kinds.values() if set(k) != {trie.MAYBE})
    alone = [k[0] for k in kinds.values() if len(k) == 1]
    assert sum(k == trie.TAIL for k in alone) > 0.6 * len(alone)  # most tails are emitted where they stand


def test_empty_table_and_one_turnless_conversation(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(alone, 1, "u", "gone")]
    assert found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)

import cases
import numpy as np
import pytest
import xxhash

from railguard.llm.graph import components
from railguard.llm.simhash import band_masks, deduplicate, fingerprints, forest, links, links_within, with_components


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def roots(values, radius=4):
    root = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= radius:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_fingerprints_and_components(spark):
    docs = cases.texts()
    marked = fingerprints(cases.documents(spark), ["doc_id"])
    rows = with_components(marked).collect()
    values = [brute(t) for _, t in docs]
    assert sorted(r["fp"] % (1 << 64) for r in rows) == sorted(values)
    root = roots(values)
    least = {}
    for (doc, _), r in zip(docs, root):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    expected = sorted(str((d, v, least.get(r))) for (d, _), v, r in zip(docs, values, root))
    assert sorted(str((r["row"]["doc_id"], r["fp"] % (1 << 64), r["component_id"])) for r in rows) == expected


@pytest.mark.parametrize("m", [1, 2, 3])
def test_every_near_pair_shares_a_band_choice(m):
    draw = np.random.default_rng(m)
    masks = band_masks(4, m)
    for _ in range(300):
        flips = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
        assert any(flips & mask == 0 for mask in masks)


def test_bit_sliced_distances_match_popcounts():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) * np.uint64(k % 7 > 0) for k in range(25)])
    block = np.sort(draw.integers(0, 4, len(fps)))
    found = {(i, j) for a, b in links_within(fps, block, np.zeros(len(fps), bool), 4) for i, j in zip(a.tolist(), b.tolist())}
    expected = {
        (i, j)
        for i in range(len(fps))
        for j in range(i + 1, len(fps))
        if block[i] == block[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 4
    }
    assert found == expected
    root = forest(len(fps), iter([(np.array([i for i, _ in expected]), np.array([j for _, j in expected]))]))
    assert all(root[i] == root[j] for i, j in expected)


def test_tiles_of_a_hot_block_lose_no_link(spark, monkeypatch):
    import railguard.llm.simhash as s

    draw = np.random.default_rng(9)
    centre = [int(x) for x in draw.integers(0, 1 << 62, 5)]
    values = sorted({c ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in draw.integers(0, 62, (30, 2))})
    distinct = spark.createDataFrame([(v,) for v in values], "fp bigint")
    root = roots(values)
    expected = {frozenset(values[i] for i in range(len(values)) if root[i] == r) for r in set(root) if root.count(r) > 1}
    for hot in (8192, 8):
        monkeypatch.setattr(s, "HOT_ROWS", hot)
        groups = {}
        for r in components(links(distinct)).collect():
            groups.setdefault(r["root"], set()).add(r["node"])
        assert {frozenset(g) for g in groups.values()} == expected


def test_one_document_of_each_group_stays(spark):
    docs = cases.documents(spark)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    values = [brute(t) for _, t in cases.texts()]
    assert len(ids) == len(set(roots(values)))
    assert (False, 5) in ids and (False, 6) not in ids
    assert deduplicate(cases.empty(spark)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100)], "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(41)}

import numpy as np
import pytest

from railguard.llm.urls import DAMPING, MARGIN, ROUNDS, filtered, host_edges, host_scores

PAGES = [
    (1, "http://a.com/x", '<a href="http://b.net/fr/1">b</a><a href="http://b.net/2">b</a><a href="/own">o</a>'),
    (2, "http://b.net/fr/q?u=1", "<a class=x HREF='//c.org/z'>c</a>"),
    (3, "https://B.NET/fr", None),
    (4, "http://c.org/", '<a href="http://b.net/">b</a>'),
    (5, "http://d.org/page#f", '<a href="https://b.net/1">1</a><a href=http://e.org/2>2</a>'),
    (6, "http://e.org", ""),
    (7, "no scheme", "<a href='http://a.com/'>a</a>"),
    (8, None, None),
    (8, None, None),
    (9, "http://www.example.com/en/1", ""),
    (10, "http://m.example.com/en/1", ""),
    (11, "http://example.com/en", ""),
    (12, "http://badexample.com/en/", ""),
    (13, "x://?q", ""),
    (14, "http://b.net/es/ü", ""),
]


def pages(spark):
    rows = [(*p, "block", 1.0) for p in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string, trust double")


def test_rules_hosts_and_paths(spark):
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filtered(pages(spark)).collect()}
    assert rows[1] == ("a.com", "/x", "com/", "allow")
    assert rows[2] == ("b.net", "/fr/q", "net/fr/", "block")
    assert rows[3][:3] == ("b.net", "/fr", None)
    assert rows[7] == rows[8] == ("", "", None, "allow")
    assert rows[9][2:] == ("www.example.com/en/", "allow") and rows[10][2:] == ("example.com/en/", "block")
    assert rows[11][2:] == ("com/", "allow") and rows[12][2:] == ("com/", "allow")
    assert rows[13][:3] == ("", "", None) and rows[14][2:] == ("net/es/", "block")
    assert filtered(pages(spark)).count() == len(PAGES) and filtered(pages(spark).limit(0)).count() == 0


def test_scores_against_matrix_form(spark):
    named = filtered(pages(spark)).select("page_id", "host", "rule")
    judged = pages(spark).select("page_id", "html").dropDuplicates(["page_id"]).join(named.dropDuplicates(["page_id"]), "page_id")
    verdict = {"com/": "allow", "net/fr/": "block", "net/es/": "block", "www.example.com/en/": "allow", "example.com/en/": "block"}
    rows = [(r["host"], r["html"], verdict.get(r["rule"])) for r in judged.collect()]
    frame = spark.createDataFrame(rows, "host string, html string, rule_verdict string")
    edges = {(r["src"], r["dst"]): r["weight"] for r in host_edges(frame).collect()}
    assert edges[("a.com", "b.net")] == 2 and ("b.net", "c.org") in edges and ("a.com", "a.com") not in edges
    hosts = sorted({h for h, _, _ in rows if h} | {h for e in edges for h in e})
    place = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts),) * 2)
    for (a, b), n in edges.items():
        w[place[a], place[b]] = n
    forth = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
    share = lambda v: np.array([np.mean([x == v for h, _, x in rows if h == host] or [0.0]) for host in hosts])
    good, bad = share("allow"), share("block")
    t, d = (1 - DAMPING) * good, (1 - DAMPING) * bad
    for _ in range(ROUNDS):
        t, d = (1 - DAMPING) * good + DAMPING * forth.T @ t, (1 - DAMPING) * bad + DAMPING * forth @ d
    got = {r["host"]: (r["trust"], r["distrust"]) for r in host_scores(frame).collect()}
    assert set(got) == set(hosts)
    for h, i in place.items():
        assert np.allclose(got[h], (t[i], d[i]), atol=1e-12)
    # All links of c.org go to b.net, but the trust of a.com reaches it through b.net as well.
    i = place["c.org"]
    assert t[i] > d[i] > MARGIN * (1 - DAMPING)
    assert {r["page_id"]: r["verdict"] for r in filtered(pages(spark)).collect()}[4] == "allow"


@pytest.mark.parametrize("linkers", [1, 2, 1000])
def test_a_farm_of_any_size_is_blocked(spark, linkers):
    farm = [(i, f"http://farm{i}.org/", '<a href="http://bad.net/fr/1">x</a>') for i in range(linkers)]
    others = [
        (-1, "http://bad.net/fr/1", ""),
        (-2, "http://alone.org/", ""),
        (-3, "http://second.org/", "".join(f'<a href="http://farm{i}.org/">x</a>' for i in range(linkers))),
        # One of many links of a trusted host, and one of four of an unknown one, go to the bad host.
        (-4, "http://good.com/", '<a href="http://bad.net/">x</a>' + "".join(f'<a href="http://fine{i}.com/">x</a>' for i in range(9))),
        (-5, "http://mixed.org/", '<a href="http://bad.net/">x</a>' + "".join(f'<a href="http://fine{i}.com/">x</a>' for i in range(3))),
        (-6, "http://liked.org/", '<a href="http://bad.net/">x</a>'),
        *[(-10 - i, f"http://fan{i}.com/", '<a href="http://liked.org/">x</a>') for i in range(3)],
    ]
    frame = spark.createDataFrame(farm + others, "page_id bigint, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in filtered(frame).collect()}
    assert {verdicts[i] for i in range(linkers)} == {"block"} and verdicts[-3] == "block"
    assert [verdicts[-i] for i in (1, 2, 4, 5, 6)] == ["block", "allow", "allow", "allow", "allow"]

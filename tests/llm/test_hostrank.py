import duckdb
import numpy as np
import pandas as pd
import pytest

from glyphgrid.llm import hostrank

HOSTS = ["good.org", "a.good.org", "news.com", "blog.com", "spam.biz", "www.spam.biz", "ring1.biz", "ring2.biz", "alone.net"]
LINKS = [(0, 1, 2), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (6, 4, 3), (6, 7, 1), (7, 6, 2), (5, 4, 1), (3, 0, 1), (2, 9, 1)]
SEEDS = (("good.org",), ("spam.biz",))


def html(page):
    names = [*HOSTS, "outside.io"]
    out = "<p>x<a href='/own'>y</a><a\n href=\"https://" + HOSTS[page] + "/self\">s</a>"
    for s, d, n in LINKS:
        if s == page:
            out += "".join(f'<A class="k" HREF="//u:p@{names[d].upper()}:80/p{i}?q#f">z</A>' for i in range(n))
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://{h}/x" if i % 2 else f"HTTP://{h.upper()}:8080/x", html(i)) for i, h in enumerate(HOSTS)]
    rows += [(20, None, "<a href='https://news.com'>"), (21, "/relative", None), (22, "https://alone.net", None), (22, "https://alone.net", None), (None, "https://spam.biz/y", "")]
    return spark.createDataFrame([(*r, "h", 1.0) for r in rows], "page_id bigint, url string, html string, host string, trust double")


def brute():
    names = [*HOSTS, "outside.io"]
    n = len(names)

    def rank(edges, seed):
        m = np.zeros((n, n))
        for s, d, c in edges:
            m[s, d] += c
        m = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
        v = np.array([float(h == seed or h.endswith("." + seed)) for h in names])
        r = v.copy()
        for _ in range(hostrank.ROUNDS):
            r = v + hostrank.DAMPING * (r @ m)
        return r

    trust, distrust = rank(LINKS, "good.org"), rank([(d, s, c) for s, d, c in LINKS], "spam.biz")
    return {h: (trust[i], distrust[i]) for i, h in enumerate(names)}


def seeds(spark):
    return hostrank.seed_table(spark, *SEEDS)


def test_scores_match_dense_iteration(spark, pages):
    want = brute()
    rows = hostrank.filter_pages(pages, seeds(spark)).collect()
    assert len(rows) == pages.count()
    for r in rows:
        t, d = want.get(r["host"], (0.0, 0.0))
        assert abs(r["trust"] - t) < 1e-8 and abs(r["distrust"] - d) < 1e-8
        assert r["keep"] == (d < hostrank.MAX_DISTRUST or t > d)
    keep = {r["host"]: r["keep"] for r in rows}
    assert keep["good.org"] and keep["alone.net"] and keep[None] and not keep["spam.biz"] and not keep["ring1.biz"] and not keep["www.spam.biz"]


def test_sql_gives_the_same(spark, pages):
    con = duckdb.connect()
    con.register("p", pages.select("page_id", "url", "html").toPandas())
    con.execute("CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM p")
    got = con.execute(hostrank.sql(*SEEDS)).df()
    own = hostrank.filter_pages(pages, seeds(spark)).toPandas()
    order = lambda d: d.sort_values(["page_id", "host"], na_position="first").reset_index(drop=True)[["page_id", "host", "trust", "distrust", "keep"]]
    a, b = order(own), order(got)
    pd.testing.assert_frame_equal(a[["trust", "distrust"]], b[["trust", "distrust"]], atol=1e-8)
    assert a["keep"].tolist() == b["keep"].tolist() and a["host"].fillna("").tolist() == b["host"].fillna("").tolist()


def test_edges(spark, pages):
    assert hostrank.filter_pages(pages.limit(0)).count() == 0
    rows = hostrank.filter_pages(pages, hostrank.seed_table(spark, (), ())).collect()
    assert all(r["trust"] == 0 and r["distrust"] == 0 and r["keep"] for r in rows)
    strict = hostrank.filter_pages(pages, seeds(spark), min_trust=0.1).collect()
    assert {r["host"] for r in strict if r["keep"]} == {h for h, (t, d) in brute().items() if t >= 0.1 and (d < 0.05 or t > d)} & set(HOSTS)


def test_seeds_hold_under_every_tld(spark):
    bad = ["m.casino-win.example.com", "free-bets.example.com", "www.spam-farm.example.com", "www.cheap-pills.example.com", "blog.adult-x.example.net", "ads-track.example.org"]
    good = ["blog.tionsh.example.com", "tionble.example.org", "m.ththnd.example.net", "ththat.example.com", "notspam-farm.example.com"]
    rows = [(i, f"https://{h}/en/{i}", "<a href='/own'>") for i, h in enumerate(bad + good)]
    got = {r["host"]: r for r in hostrank.filter_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [h for h in got if not got[h]["keep"]] == [h for h in got if h in bad] and len(got) == len(rows)
    assert all(got[h]["distrust"] >= 1 for h in bad) and all(got[h]["trust"] >= 1 for h in good[:3])


def test_hosts_of_odd_urls(spark):
    urls = {"https://[2001:DB8::1]:8080/x": "[2001:db8::1]", "http://Good.org./a": "good.org", "//u@h.net:1?q": "h.net", "mailto:a@b.c": None, "/x": None, "http://": None, None: None, "": None}
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string").select("url", hostrank.host("url").alias("h")).collect()
    assert {r["url"]: r["h"] for r in rows} == urls


def test_broken_html_costs_no_more_than_its_length(spark):
    import time

    text = "<a x " * 200_000 + "<a href=//far.net/>"
    df = spark.createDataFrame([(1, "http://h.org/", text)], "page_id bigint, url string, html string")
    began = time.time()
    assert [tuple(r) for r in hostrank.host_edges(df).collect()] == [("h.org", "far.net", 1)]
    assert time.time() - began < 20


def test_propagation_on_the_trade_graph(spark):
    """Real edges between thousands of hosts: Spark, SQL and dense iteration agree, and most scores come by links."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders", "lineitem")]
    got = {r["host"]: (r["trust"], r["distrust"], r["keep"]) for r in hostrank.trade_ranks(*tables).collect()}
    want = {h: (t, d, k) for h, t, d, k in con.execute(hostrank.trade_sql()).fetchall()}
    assert got.keys() == want.keys() and all(abs(got[h][0] - want[h][0]) + abs(got[h][1] - want[h][1]) < 3e-9 and got[h][2] == want[h][2] for h in got)
    assert sum(0 < t < 1 for t, _, _ in got.values()) > 50 and sum(not k for *_, k in got.values()) > 3

    edges = hostrank.trade_graph(*tables)[1].collect()
    names = sorted({r["src"] for r in edges} | {r["dst"] for r in edges})
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in edges:
        m[at[r["src"]], at[r["dst"]]] = r["n"]
    for k, (w, seeds_) in enumerate(((m, hostrank.TRADE_SEEDS[0]), (m.T, hostrank.TRADE_SEEDS[1]))):
        w = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
        v = np.array([float(h in seeds_) for h in names])
        r = v.copy()
        for _ in range(hostrank.ROUNDS):
            r = v + hostrank.DAMPING * (r @ w)
        assert all(abs(r[at[h]] - got.get(h, (0, 0))[k]) < 1e-8 for h in names)


def test_the_plan_does_not_double_with_rounds(spark, pages):
    edges, hosts = hostrank.host_edges(pages), pages.select(hostrank.host("url").alias("host"))
    size = lambda n: hostrank.rank(hosts, edges, seeds(spark), n)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert size(8) <= size(2) + 6


def test_hubs_in_parts_give_the_same(spark, pages, monkeypatch):
    """A host's steps in many parts, met by as many copies of what it has; a round's plan reads files, not earlier rounds."""
    edges, hosts = hostrank.host_edges(pages), pages.select(hostrank.host("url").alias("host"))
    monkeypatch.setattr(hostrank, "HUB", 1)
    found = hostrank.rank(hosts, edges, seeds(spark), 6)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in found.collect()}
    assert "/kept-" in found.inputFiles()[0] and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    assert got == {r["host"]: (r["trust"], r["distrust"]) for r in hostrank.rank(hosts, edges, seeds(spark), 6).collect()}

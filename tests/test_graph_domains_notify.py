"""BFS against a Python BFS, domain analytics, notification batches, images."""

import random
import re
from collections import deque

from pyspark.sql import functions as F

from sitelens.operators import domains as DM
from sitelens.operators import graph as GR
from sitelens.operators import images as IM
from sitelens.operators import links as LK
from sitelens.operators import notify as NT


def py_bfs(seeds, edges, max_depth, excluded):
    adj = {}
    for s, d in edges:
        adj.setdefault(s, []).append(d)
    visited, out = set(), {}
    q = deque((s, 0) for s in seeds)
    while q:
        u, d = q.popleft()
        if u in visited or d > max_depth:
            continue
        visited.add(u)
        if excluded(u):
            continue
        out[u] = d
        if d < max_depth:
            for v in adj.get(u, []):
                if v not in visited:
                    q.append((v, d + 1))
    return out


def test_bfs_matches_python(spark):
    rng = random.Random(3)
    n = 60
    urls = [f"https://s{i % 5}.com/p{i}" for i in range(n)] + ["https://s1.com/x.pdf"]
    edges = [(urls[rng.randrange(n)], urls[rng.randrange(n + 1)]) for _ in range(150)]
    edges += [("https://s1.com/x.pdf", urls[7])]
    seeds = [urls[0], urls[1]]
    pat = re.compile(LK.DEFAULT_EXCLUDES[0])
    for depth in (0, 1, 3):
        exp = py_bfs(seeds, edges, depth, lambda u: pat.search(u) is not None)
        got = GR.crawl_bfs(spark.createDataFrame([(s,) for s in seeds], "url string"),
                           spark.createDataFrame(edges, "src_url string, dst_url string"), depth).collect()
        assert {r.url: r.depth for r in got} == exp
    lim = GR.limit_pages(GR.crawl_bfs(spark.createDataFrame([(seeds[0],)], "url string"),
                                      spark.createDataFrame(edges, "src_url string, dst_url string"), 3), 5).collect()
    assert len(lim) <= 5 and [r.depth for r in lim] == sorted(r.depth for r in lim)


def test_page_links_and_filters(spark):
    html = '<a href="/a">A</a> <a href="HTTP://WWW.Other.com/b/?z=1&a=2">B</a> <a href="mailto:x@y">M</a> <a href="rel">R</a> <a href="/a">A2</a>'
    df = spark.createDataFrame([("https://www.site.com/dir/p", html)], "url string, html string")
    links = LK.page_links(df).orderBy("pos").collect()
    assert [(r.pos, r.dst_url) for r in links] == [(0, "https://site.com/a"), (1, "http://other.com/b?a=2&z=1"),
                                                     (3, "https://site.com/dir/rel"), (4, "https://site.com/a")]
    allowed = LK.page_links(df, allowed=["site.com"]).count()
    assert allowed == 3
    u = spark.createDataFrame([("https://a.com/x.pdf",), ("https://a.com/wp-admin/x",), ("https://a.com/ok?utm_x=1",), ("https://a.com/ok",)], "url string")
    assert [r.url for r in LK.exclude_urls(u).collect()] == ["https://a.com/ok"]
    assert LK.exclude_urls(u, mode="match").count() == 2  # start-anchored: path patterns never fire
    assert LK.fan_out(u.limit(1)).count() == 3


def test_domain_features_and_summary(spark):
    doms = ["login123.example.com", "secure-bank.io", "verify-account.app", "localhost", "my-wallet-verify.cn", "a1b2.org"]
    df = spark.createDataFrame([(d,) for d in doms], "domain string")
    a = {r.domain: r for r in DM.analyze_domains(df).collect()}
    r = a["login123.example.com"]
    assert (r.length, r.num_parts, r.num_digits, r.num_hyphens, r.tld, r.tld_category) == (20, 3, 3, 0, "com", "generic")
    assert r.suspicious_patterns == [r"login.*\d+"]
    assert a["localhost"].tld == "" and a["localhost"].tld_category == "other"
    assert a["my-wallet-verify.cn"].suspicious_patterns == [r"wallet.*verify"] and a["my-wallet-verify.cn"].tld_category == "country"
    assert a["verify-account.app"].tld_category == "new"
    s = {(r.metric, r.key): r.value for r in DM.domain_summary(DM.analyze_domains(df)).collect()}
    assert s[("total_domains", "")] == 6 and s[("tld_distribution", "com")] == 1
    assert abs(s[("avg_domain_length", "")] - sum(len(d) for d in doms) / 6) < 1e-6


def test_whois_dns_enrichment(spark):
    df = DM.analyze_domains(spark.createDataFrame([("a.com",), ("b.com",)], "domain string"))
    whois = spark.createDataFrame([("a.com", "2020-01-01", "Reg", "US")], "domain string, creation_date string, registrar string, country string")
    dns = spark.createDataFrame([("a.com", "A", "1.2.3.4"), ("a.com", "A", "1.1.1.1"), ("a.com", "MX", "mx.a.com")], "domain string, type string, value string")
    got = {r.domain: r for r in DM.enrich_dns(DM.enrich_whois(df, whois), dns).collect()}
    assert got["a.com"].whois.registrar == "Reg" and got["b.com"].whois is None
    assert got["a.com"].dns["A"] == ["1.1.1.1", "1.2.3.4"] and got["b.com"].dns is None
    assert got["a.com"].dns == {"A": ["1.1.1.1", "1.2.3.4"], "MX": ["mx.a.com"], "NS": None, "TXT": None}


def test_domain_dataset_union(spark):
    new = spark.createDataFrame([(" a.com ", "2024-01-01")], "domain string, date string")
    ph = spark.createDataFrame([("b.com",)], "domain string")
    ds = DM.domain_dataset(new, ph, "2024-02-02").collect()
    assert sorted((r.domain, r.source, r.date, r.type) for r in ds) == [
        ("a.com", "whoisds", "2024-01-01", "new_registration"), ("b.com", "phishing_list", "2024-02-02", "phishing")]
    assert DM.union_domains(ph, ph, distinct=True).count() == 1 and DM.union_domains(ph, ph).count() == 2


def test_notify_batches_chunks_and_engines(spark):
    urls = [f"https://h.com/p{i:02d}" for i in range(25)] + ["http://h.com/x", "https://solo.org/only", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    b = NT.notify_batches(df, "k", max_urls=10).orderBy("origin", "chunk").collect()
    hb = [r for r in b if r.origin == "https://h.com"]
    assert [r.n_urls for r in hb] == [10, 10, 5] and hb[0].urlList[0] == "https://h.com/p00"
    assert hb[0].keyLocation == "https://h.com/k.txt" and hb[0].host == "h.com"
    single = NT.notify_batches(df, "k", bulk=False).count()
    assert single == 27
    f = NT.fan_out_engines(NT.notify_batches(df, "k"), ("bing", "bogus")).collect()
    assert {r.error for r in f if r.engine == "bogus"} == {"No endpoint known for bogus"}
    roll = {r.engine: r for r in NT.notify_rollup(
        NT.fan_out_engines(NT.notify_batches(df, "k"), ("bing", "bogus")).withColumn("success", F.col("error").isNull())).collect()}
    assert roll["bing"].overall_success is True and roll["bogus"].success_count == 0


def test_user_agents(spark):
    df = spark.createDataFrame([("Googlebot",), ("nope",), (None,)], "ua_key string")
    got = [r.user_agent for r in NT.with_user_agent(df).collect()]
    assert got[0].startswith("Mozilla/5.0 (compatible; Googlebot") and got[1] == got[2] == NT.DEFAULT_USER_AGENT
    assert len(NT.USER_AGENTS) == 21


def test_images_filters_dedupe(spark):
    df = spark.createDataFrame([
        ("https://a.com/x.JPG", None, 50, 200, 1, 0), ("https://a.com/y", "image/png", 300, 300, 0, 1),
        ("https://a.com/z.txt", "text/plain", None, None, 0, 2), ("https://a.com/x.JPG", None, 50, 200, 0, 5)],
        "url string, content_type string, px_width int, px_height int, page_seq int, pos int")
    imgs = IM.filter_images(df)
    assert sorted(r.url for r in imgs.collect()) == ["https://a.com/x.JPG", "https://a.com/x.JPG", "https://a.com/y"]
    assert [r.url for r in IM.min_image_size(imgs).collect()] == ["https://a.com/y"]
    first = {r.url: (r.page_seq, r.pos) for r in IM.first_seen_images(df).collect()}
    assert first["https://a.com/x.JPG"] == (0, 5)
    d = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "id long, body string")
    dd = {r.id: r.n_copies for r in IM.dedupe_by_hash(d, "body", "id").collect()}
    assert dd == {1: 2, 3: 1}


def test_dedupe_by_hash_ties_and_nulls(spark):
    rows = [(2, "x", "b"), (1, "x", "a"), (1, "x", "a"), (None, "x", "c"), (None, "y", "d"), (3, None, "e"), (4, None, "f"), (5, "z", "g"), (5, "z", "h")]
    got = IM.dedupe_by_hash(spark.createDataFrame(rows, "id long, body string, more string"), "body", "id").collect()
    assert sorted((r.body or "", r.id, r.n_copies) for r in got if r.body != "y") == [("", 3, 2), ("x", 1, 4), ("z", 5, 2)]
    assert [(r.id, r.more, r.n_copies) for r in got if r.body == "y"] == [(None, "d", 1)]
    assert {r.more for r in got if r.body == "x"} == {"a"} and len(got) == 4
    assert IM.dedupe_by_hash(spark.createDataFrame([], "id long, body string"), "body", "id").collect() == []

import ipaddress
import random

from pyspark.sql import functions as F

from folioforge.operators import access, crawl


def loop(start, pages, links, most_pages, most_articles):
    """One list after the other, page by page."""
    url, seen, found, n, empty, stale = start, set(), [], 0, 0, 0
    while True:
        page = pages.get(url)
        if page is None:
            return "fetch_failed", False, n + 1, found
        digest, nxt, script = page
        if digest in seen:
            return "duplicate_page", True, n, found
        seen.add(digest)
        n += 1
        own = list(dict.fromkeys(links.get(url, [])))
        new = [x for x in own if x not in found]
        found += new
        empty, stale = empty + 1 if not own else 0, stale + 1 if not new else 0
        if empty >= 2:
            return "empty_pages", bool(found), n, found
        if stale >= 2:
            return "no_new_articles", True, n, found
        if len(found) >= most_articles:
            return "max_articles", True, n, found[:most_articles]
        if n >= most_pages:
            return "max_list_pages", True, n, found
        if nxt is None:
            return ("requires_adapter", False, n, found) if script else ("no_next_page", True, n, found)
        url = nxt


def test_list_crawls_equal_a_loop_with_cycles_and_missing_pages(spark):
    rnd = random.Random(5)
    names = [f"u{i}" for i in range(300)]
    pages = {u: (f"h{rnd.randrange(280)}", rnd.choice([None, "gone", *rnd.sample(names, 8)]), rnd.random() < 0.5) for u in names}
    links = {u: [f"a{rnd.randrange(12)}" for _ in range(rnd.choice([0, 0, 1, 3, 6]))] for u in names}
    stored = spark.createDataFrame([(u, *p) for u, p in pages.items()] + [(None, "x", None, False)], "url string, hash string, next_url string, script boolean")
    rows = spark.createDataFrame([(u, i, a) for u, x in links.items() for i, a in enumerate(x)] + [("u1", 99, None), (None, 1, "a")], "url string, pos int, link string")
    starts = spark.createDataFrame([(u, u) for u in names] + [("none", None)], "list_id string, url string")
    done = crawl.crawl_lists(starts, stored, rows, 5, 9)
    got = {r.list_id: (r.stop_reason, r.complete, r.n_pages, r.n_articles) for r in done.lists.collect()}
    order = {}
    for r in sorted(done.articles.collect(), key=lambda r: r["rank"]):
        order.setdefault(r.list_id, []).append(r.link)
    want = {u: loop(u, pages, links, 5, 9) for u in names} | {"none": ("fetch_failed", False, 1, [])}
    assert len({x[0] for x in want.values()}) == 8
    assert got == {u: (a, b, c, len(d)) for u, (a, b, c, d) in want.items()}
    assert order == {u: x[3] for u, x in want.items() if x[3]}
    empty = crawl.crawl_lists(starts.limit(0), stored, rows)
    assert empty.lists.count() == empty.articles.count() == 0


def test_next_pages_by_text_number_and_count(spark):
    pages = [
        (1, "http://h/a/list.htm", '<a href="x">1</a><a href="list7.htm">下一页</a>'),
        (2, "http://h/a/list3.htm", '<span class="current">3</span><a href="#">4</a><a href="/b/list4.htm">4</a>'),
        (3, "http://h/a/list3.htm", "共 9 页"),
        (4, "http://h/a/?page=2&x=1", "共 9 页"),
        (5, "http://h/a/x.htm", "<p data-page='3'></p>"),
        (6, "http://h/a/list.htm", '<a href="http://h/">home</a>'),
        (7, None, None),
        (8, "http://h/a/list.htm", '<a href="javascript:go(2)">next</a>'),
    ]
    rows = crawl.next_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.next_url for r in rows}
    assert got == {1: "http://h/a/list7.htm", 2: "http://h/b/list4.htm", 3: "http://h/a/list4.htm", 4: "http://h/a/?page=3&x=1", 5: None, 6: None, 7: None, 8: "http://h/a/list2.htm"}
    assert [r.page_id for r in rows if r.script] == [5]


def test_site_profiles_of_lists(spark):
    item = lambda k: f'<li><a href="/info/a{k}/x.htm?id={k}">t</a> 2024-01-0{k}</li>'
    html = '<div class="side"><a href="/info/9">z</a></div><ul class="news list">' + "".join(item(k) for k in (1, 2, 3, 3)) + '</ul><a href="http://other/info/7">o</a>'
    pages = spark.createDataFrame([(1, "http://h/list.htm", html), (2, "http://h/none.htm", "<p>x"), (3, "http://h/null.htm", None)], "page_id long, url string, html string")
    columns = crawl.list_columns(pages, article=r"/info/")
    r = columns.collect()
    assert len(r) == 1 and r[0].signature == "ul.news.list" and r[0].n_links == 3 and r[0].dates == 4 and r[0].prefix == "http://h/info/" and len(r[0].samples) == 3 and r[0].score == 3.4
    homes = [(1, 0, "通知公告", "http://h/list.htm"), (1, 1, "again", "http://h/list.htm"), (1, 2, "通知", "http://h/none.htm"), (1, 3, "联系我们", "http://h/list.htm"), (2, 0, "版权 通知", "http://h/list.htm"), (3, 0, None, None)]
    got = crawl.site_profiles(spark.createDataFrame(homes, "home_id long, pos int, name string, url string"), columns, {"通知": 3.0}, {"新闻": -1.0}).collect()
    assert [(r.home_id, r["rank"], r.name, r.score) for r in got] == [(1, 1, "通知公告", 7.4)]
    pairs = [("abc/d", "abc/e"), ("x", "y"), ("", "a"), ("same", "same"), ("ab", "abc")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(crawl.common_prefix(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == ["abc/", "", "", "same", "ab"]


def test_address_literals_equal_the_standard_library(spark):
    rnd = random.Random(9)
    nets = [ipaddress.ip_network(c) for c in access.PRIVATE + access.PUBLIC]
    found = [str(n[k]) for n in nets for k in (0, -1, rnd.randrange(n.num_addresses))]
    found += [str(n[0] - 1) for n in nets if int(n[0])] + [str(n[-1] + 1) for n in nets if int(n[-1]) < 2 ** n.max_prefixlen - 1]
    found += [str(ipaddress.ip_address(rnd.randbytes(4))) for _ in range(200)] + [str(ipaddress.ip_address(rnd.randbytes(16))) for _ in range(200)]
    found += ["::ffff:10.0.0.1", "::ffff:8.8.8.8", "::1.2.3.4", "1:2:3:4:5:6:7.8.9.1", "1::8.8.8.8"]
    bad = ["1.2.3", "01.2.3.4", "256.1.1.1", "1:2", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "12345::", "g::", "1:2:3:4:5:6:7:", "::1.2.3.400", "name.example", "", None]
    rows = spark.createDataFrame([(x,) for x in found + bad], "h string").select("h", access.address(F.col("h")).alias("at"), access.private_host(F.col("h")).alias("p")).collect()
    for r in rows:
        if r.h in bad:
            assert r.at is None and not r.p, r
            continue
        ip = ipaddress.ip_address(r.h)
        four = ip.ipv4_mapped if ip.version == 6 else ip
        whole = access.MAPPED + format(int(four), "08x") if four else format(int(ip), "032x")
        ip = four or ip
        assert r.at == whole, r
        assert r.p == (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified), r


def test_rules_by_longest_prefix_equal_a_loop(spark):
    text = {
        "a": ["# c", "Disallow: /before", "User-agent: other", "User-agent: *", "Disallow: /", "Allow: /p", "disallow: /p/q # x", "Allow: /p/q", "Disallow: /p/q/r", "Disallow:", "Crawl-delay: 2.5", "", "User-agent: *", "Allow: /"],
        "b": ["User-agent: *", "Disallow: /", "User-agent: Folio", "Crawl-delay: 3", "Disallow: /x"],
        "c": ["Disallow: /"],
    }
    lines = spark.createDataFrame([(h, i, x) for h, t in text.items() for i, x in enumerate(t)], "host string, line_no int, line string")
    rules = access.rules_of(lines, "folio")
    status = spark.createDataFrame([("a", 200), ("b", 200), ("c", 200), ("d", 404), ("e", 403), ("f", 500), ("10.0.0.1", 200)], "host string, status int")
    want = {
        "http://a/": "robots_denied", "http://a/p": "ok", "http://A/p/q/1": "ok", "http://a/p/q/r?x=1": "robots_denied", "http://a": "robots_denied", "http://b/y": "ok", "https://b/x1": "robots_denied", "http://c/": "ok", "http://d/z": "ok",
        "http://e/": "robots_denied", "http://f/": "robots_denied", "http://g/": "robots_denied", "ftp://a/p": "unsupported_scheme", "http://me@a/p": "userinfo_blocked", "http://10.0.0.1/": "private_address_blocked", "http://[::1]:80/": "private_address_blocked",
        "http://localhost./": "private_address_blocked", "mailto:x": "unsupported_scheme", "http:///p": "unsupported_scheme", None: "unsupported_scheme",
    }
    urls = spark.createDataFrame(list(enumerate(want)), "url_id long, url string")
    got = {r.url_id: r for r in access.checked(urls, rules, status).collect()}
    assert [got[i].verdict for i in range(len(want))] == list(want.values())
    at = {u: i for i, u in enumerate(want)}
    assert got[at["http://a/p"]].seconds == 2.5 and got[at["http://b/y"]].seconds == 3 and got[at["http://d/z"]].seconds is None
    only = access.checked(urls, rules, status, spark.createDataFrame([("a",), ("g",)], "host string"))
    known = {r.url_id: r.verdict for r in only.collect()}
    assert known[at["http://b/y"]] == "redirect_blocked" and known[at["http://a/p"]] == "ok" and known[at["http://g/"]] == "robots_denied"
    assert access.checked(urls.limit(0), rules, status).count() == 0 and len(access.checked(urls, rules.limit(0), status).where("verdict = 'ok'").collect()) > 0


def test_list_crawls_of_addresses_stored_twice_equal_their_sql(spark, tmp_path):
    """every stored version of an address is followed, as in the SQL; the rows are such that it leaves no tie open."""
    import duckdb

    import __spark_entry__ as entry

    body = lambda k, links: "".join(f'<a href="/{a}">x</a>' for a in links) + "t" * k
    rows = [(0, "http://h/a", body(1, "ab")), (1, "http://h/b", body(8, "cd")), (2, "http://h/b", body(30, "ef"))]
    rows += [(20, "http://i/a", body(1, "abc")), (21, "http://i/a", body(1, "abc")), (22, "http://i/b", body(7, "d")), (40, "http://j/z", body(6, "ab")), (60, "http://j/z", body(9, "ghikl")), (61, None, "x"), (62, "http://j/n", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name, key in (("s40_list_crawls", ("list_id",)), ("s42_list_articles", ("list_id", "rank"))):
        want = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        got = entry.queries()[name](spark, str(tmp_path)).select(*names).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str), name
        assert len({tuple(r[k] for k in key) for r in got}) == len(got)

"""Queries of list crawls, site profiles and access rules over the stored pages, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import text, web
from folioforge.operators import access, crawl
from folioforge.operators import links as anchors
from folioforge.plans.registry import query
from folioforge.plans.structures import SQL_TOKENS
from folioforge.plans.views import table

#: Pages of a host in runs of 16 by page_id are a list that ends in its first page; some lack a next page or point at one that isn't stored.
CHAIN, PAGES, ARTICLES = 16, 8, 12
SQL_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
SQL_LISTS = rf"""p AS (SELECT page_id, url, html, {SQL_HOST} AS host, page_id // {CHAIN} AS run FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
nx AS (SELECT *, coalesce(lead(url) OVER w, first_value(url) OVER w) AS nxt FROM p WINDOW w AS (PARTITION BY host, run ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
stored AS (SELECT url, sha256(regexp_replace(html, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', '', 'g')) AS hash, CASE WHEN length(html) % 11 = 0 THEN NULL WHEN length(html) % 13 = 0 THEN url || '!' ELSE nxt END AS next_url, length(html) % 2 = 0 AS script FROM nx),
al AS (SELECT url, host, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) AS pos FROM p),
own AS (SELECT url, host || href AS link, min(pos) AS pos FROM al WHERE regexp_matches(href, '^/[a-z]{{1,3}}$') GROUP BY ALL)"""
SQL_WALK = rf"""WITH RECURSIVE {SQL_LISTS},
walk AS (SELECT url AS list_id, 1 AS page, url, CAST([] AS VARCHAR[]) AS seen FROM stored
UNION ALL SELECT w.list_id, w.page + 1, s.next_url, list_append(w.seen, s.hash) FROM walk w JOIN stored s ON s.url = w.url WHERE w.page < {PAGES} AND s.next_url IS NOT NULL AND NOT list_contains(w.seen, s.hash)),
x AS (SELECT w.list_id, w.page, w.url, s.hash, s.next_url, s.script, s.hash IS NOT NULL AND list_contains(w.seen, s.hash) AS again FROM walk w LEFT JOIN stored s ON s.url = w.url),
fr AS (SELECT list_id, link, min(page) AS page, arg_min(pos, page) AS pos FROM x JOIN own ON own.url = x.url WHERE hash IS NOT NULL AND NOT again GROUP BY ALL),
c AS (SELECT x.*, (SELECT count(*) FROM own WHERE own.url = x.url) AS n_links, (SELECT count(*) FROM fr WHERE fr.list_id = x.list_id AND fr.page = x.page) AS n_new FROM x),
d AS (SELECT *, sum(n_new) OVER v AS total, n_links = 0 AND lag(n_links) OVER v = 0 AS empty2, n_new = 0 AND lag(n_new) OVER v = 0 AS stale2 FROM c WINDOW v AS (PARTITION BY list_id ORDER BY page)),
e AS (SELECT list_id, page, total, CASE WHEN hash IS NULL THEN 'fetch_failed' WHEN again THEN 'duplicate_page' WHEN empty2 THEN 'empty_pages' WHEN stale2 THEN 'no_new_articles' WHEN total >= {ARTICLES} THEN 'max_articles' WHEN page >= {PAGES} THEN 'max_list_pages' WHEN next_url IS NULL THEN CASE WHEN script THEN 'requires_adapter' ELSE 'no_next_page' END END AS reason FROM d),
z AS (SELECT list_id, min(page) AS stop, arg_min(reason, page) AS reason, arg_min(total, page) AS total FROM e WHERE reason IS NOT NULL GROUP BY list_id)"""


def _crawl(spark, sf):
    p = table(spark, sf, "pages").where("url is not null and html is not null").select("page_id", "url", "html", text.host(F.col("url")).alias("host"), F.expr(f"page_id div {CHAIN}").alias("run"))
    w = Window.partitionBy("host", "run").orderBy("page_id")
    after = F.coalesce(F.lead("url").over(w), F.first("url").over(w))
    n = F.length("html")
    chained = p.select("url", web.page_hash(F.col("html")).alias("hash"), n.alias("n"), "host", "run", "page_id").withColumn("after", after)
    stored = chained.select("url", "hash", F.when(F.col("n") % 11 == 0, None).when(F.col("n") % 13 == 0, F.concat("url", F.lit("!"))).otherwise(F.col("after")).alias("next_url"), (F.col("n") % 2 == 0).alias("script"))
    hrefs = anchors.page_links(p.select(F.struct("url", "host").alias("page_id"), "html")).where(F.col("href").rlike("^/[a-z]{1,3}$"))
    return crawl.crawl_lists(stored.select(F.col("url").alias("list_id"), "url"), stored, hrefs.select("page_id.url", "pos", F.concat("page_id.host", "href").alias("link")), PAGES, ARTICLES, every_version=True)


@query(f"{SQL_WALK} SELECT list_id, reason AS stop_reason, CASE reason WHEN 'empty_pages' THEN total > 0 ELSE reason NOT IN ('fetch_failed', 'requires_adapter') END AS complete, CAST(stop - (CASE WHEN reason = 'duplicate_page' THEN 1 ELSE 0 END) AS BIGINT) AS n_pages, CAST(least(total, {ARTICLES}) AS BIGINT) AS n_articles FROM z")
def s40_list_crawls(spark, sf):
    """S-40, S-42: every page starts a list; where each ends and why."""
    return _crawl(spark, sf).lists


@query(f"{SQL_WALK}, r AS (SELECT fr.list_id, link, row_number() OVER (PARTITION BY fr.list_id ORDER BY fr.page, pos, link) AS rank FROM fr JOIN z ON z.list_id = fr.list_id WHERE fr.page <= z.stop) SELECT list_id, CAST(rank AS INTEGER) AS rank, link FROM r WHERE rank <= {ARTICLES}")
def s42_list_articles(spark, sf):
    """S-40, S-42: the articles of every list in order of discovery."""
    return _crawl(spark, sf).articles


NEXT_WORDS = r"^(de|the|in|is|un)$"


@query(
    rf"""WITH la AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS anchor, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) AS pos FROM pages),
b AS (SELECT page_id, arg_min(href, pos) AS href FROM la WHERE regexp_matches(anchor, '{NEXT_WORDS}') AND starts_with(href, '/') GROUP BY page_id),
q AS (SELECT page_id, url, html, regexp_extract(url, '[?&]page=(\d+)', 1) AS n FROM pages)
SELECT q.page_id, CASE WHEN b.href IS NOT NULL THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || b.href WHEN n <> '' AND length(html) % 3 < 2 THEN regexp_replace(url, '([?&]page=)\d+', '\1' || (CAST(n AS BIGINT) + 1)) END AS next_url, b.href IS NULL AND n = '' AND length(html) % 3 = 1 AS script FROM q LEFT JOIN b ON b.page_id = q.page_id"""
)
def x35_next_pages(spark, sf):
    """X-35: the next page of a list by a link's text, else by the page parameter where a pager tells of several pages."""
    n = F.length("html") % 3
    html = F.concat("html", F.when(n == 0, "<p>共 9 页</p>").when(n == 1, "<p data-page='2'></p>").otherwise(""))
    pages = table(spark, sf, "pages").select("page_id", "url", html.alias("html"))
    return crawl.next_pages(pages, NEXT_WORDS)


GOOD, BAD = {"the": 2.0, "de": 1.5, "in": 1.0, "e": 0.5}, {"was": -1.0, "ion": -2.0}
SQL_STORED = rf"""st AS (SELECT page_id, html, {SQL_HOST} AS host, regexp_extract(html, '(?is)<a\b[^>]*href="(/[^"]*)"', 1) AS way FROM pages),
sp AS (SELECT min(page_id) AS page_id, 'http://' || host || way AS url, host, arg_min(html, page_id) AS html FROM st WHERE way <> '' AND host <> '' GROUP BY host, way)"""
SQL_COLUMNS = rf"""{SQL_TOKENS}, {SQL_STORED},
s AS (SELECT *, nullif(regexp_extract(token, '(?is)\sclass\s*=\s*"([^"]*)"', 1), '') AS c FROM tok WHERE kind = 'start'),
up AS (SELECT l.page_id, l.pos, l.depth, j, regexp_extract(l.token, '(?is)\shref\s*=\s*"([^"]*)"', 1) AS href FROM s l, range(0, 4) t(j) WHERE l.tag = 'a' AND l.depth - j > 0),
f AS (SELECT up.*, (SELECT arg_max(CASE WHEN p.c IS NULL THEN '' ELSE p.tag || '.' || replace(p.c, ' ', '.') END, p.pos) FROM s p WHERE p.page_id = up.page_id AND p.depth = up.depth - up.j AND p.pos <= up.pos) AS name FROM up),
b AS (SELECT page_id, pos, href, coalesce(arg_min(name, j) FILTER (name <> ''), 'a') AS signature FROM f GROUP BY page_id, pos, href),
g AS (SELECT sp.page_id, sp.url, sp.host, b.signature, 'http://' || sp.host || href AS link, min(b.pos) AS pos, len(regexp_extract_all(sp.html, 'tion')) AS dates FROM sp JOIN b ON b.page_id = sp.page_id WHERE regexp_matches(href, '^/[a-z]+$') GROUP BY ALL),
gr AS (SELECT page_id, url, signature, dates, count(*) AS n_links, min(pos) AS pos, min(link) AS lo, max(link) AS hi FROM g GROUP BY ALL),
best AS (SELECT * FROM gr WHERE n_links >= 3 AND dates >= 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_links DESC, pos) = 1),
cols AS (SELECT page_id, url, signature, n_links, dates, regexp_replace(left(lo, (SELECT coalesce(max(k), 0) FROM range(1, 400) t(k) WHERE k <= length(lo) AND left(lo, k) = left(hi, k))), '[^/]*$', '') AS prefix,
  round(2.0 + CASE WHEN dates >= 3 THEN least(dates, 10) * 0.2 ELSE 0 END + least(n_links, 15) * 0.2, 6) AS score FROM best)"""


def _stored(spark, sf):
    """Pages stored under the address of their first link, of several on a host the first."""
    way = F.regexp_extract("html", r'(?is)<a\b[^>]*href="(/[^"]*)"', 1)
    rows = table(spark, sf, "pages").select("page_id", "html", text.host(F.col("url")).alias("host"), way.alias("way")).where("way <> '' and host <> ''")
    first = rows.groupBy("host", "way").agg(F.min("page_id").alias("page_id"))
    return rows.join(first, ["host", "way", "page_id"]).select("page_id", F.concat(F.lit("http://"), "host", "way").alias("url"), "html")


@query(f"WITH {SQL_COLUMNS} SELECT page_id, signature, n_links, CAST(dates AS INTEGER) AS dates, prefix, CAST(score AS DOUBLE) AS score FROM cols")
def a20_list_columns(spark, sf):
    """A-20: pages that are lists, by their largest group of links, with what these begin with."""
    return crawl.list_columns(_stored(spark, sf), "^/[a-z]+$", "tion").select("page_id", "signature", "n_links", "dates", "prefix", "score")


def _words(words):
    return "CASE " + " ".join(f"WHEN contains(name, '{w}') THEN {x}" for w, x in words.items()) + " ELSE 0 END"


@query(
    rf"""WITH {SQL_COLUMNS}, an AS (SELECT page_id AS home_id, {SQL_HOST} AS host, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="(/[^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="(/[^"]*)"[^>]*>([^<]*)</a>', 2)) AS name, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href="(/[^"]*)"[^>]*>([^<]*)</a>', 1), 1) AS pos FROM pages),
o AS (SELECT home_id, 'http://' || host || href AS url, min(pos) AS pos, arg_min(trim(name), pos) AS name FROM an WHERE trim(name) <> '' AND length(trim(name)) <= 20 GROUP BY ALL),
w AS (SELECT *, {_words(GOOD)} + {_words(BAD)} AS before FROM o),
v AS (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY before DESC, pos, url) AS probe FROM w WHERE before > 0),
m AS (SELECT v.home_id, v.name, v.url, cols.signature, cols.prefix, v.probe, round(v.before + cols.score, 6) AS score FROM v JOIN cols ON cols.url = v.url WHERE probe <= 15),
rk AS (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY score DESC, probe) AS rank FROM m WHERE score >= 3.0)
SELECT home_id, CAST(rank AS INTEGER) AS rank, name, url, signature, prefix, CAST(score AS DOUBLE) AS score FROM rk WHERE rank <= 12"""
)
def s46_site_profiles(spark, sf):
    """S-46, T-07: every page as the home of its host's profile."""
    homes = table(spark, sf, "pages").select(F.struct("page_id", text.host(F.col("url")).alias("host")).alias("page_id"), "html")
    found = anchors.page_links(homes).where("startswith(href, '/')")
    links = found.select(F.col("page_id.page_id").alias("home_id"), "pos", F.col("anchor").alias("name"), F.concat(F.lit("http://"), "page_id.host", "href").alias("url"))
    return crawl.site_profiles(links, crawl.list_columns(_stored(spark, sf), "^/[a-z]+$", "tion"), GOOD, BAD)


#: Address literals of many kinds, dealt by a digest of the page.
LITERALS = (("10.1.2.3", True), ("8.8.4.4", False), ("[::1]", True), ("[2606:4700::1111]", False), ("172.31.0.9", True), ("172.32.0.9", False), ("[fd12:3456::1]", True), ("[::ffff:192.168.0.1]", True), ("[::ffff:9.9.9.9]", False), ("a.localhost", True), ("192.0.0.9", False), ("224.0.0.1", True), ("[2001:db8::5]", True), ("256.1.1.1", False))
SQL_LITERALS = "[" + ", ".join(f"'{x}'" for x, _ in LITERALS) + "]"
SQL_CLOSED = "[" + ", ".join(str(y).lower() for _, y in LITERALS) + "]"
SQL_RULES = rf"""u AS (SELECT page_id, {SQL_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS path, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, length(html) AS n, ('0x' || left(md5(html), 4))::INTEGER AS d FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
rl AS (SELECT host, n % 4 AS kind, min(path) AS lo, max(path) AS hi FROM u GROUP BY ALL),
ru AS (SELECT host, left(lo, 4) AS prefix, true AS allow FROM rl WHERE kind = 0 UNION ALL SELECT host, left(hi, 3), false FROM rl WHERE kind IN (0, 1) UNION ALL SELECT host, left(hi, 6), true FROM rl WHERE kind = 1 UNION ALL SELECT host, left(lo, 5), false FROM rl WHERE kind = 2),
hs AS (SELECT host, CASE min(n) % 9 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN NULL ELSE 200 END AS status, CAST(max(n) % 7 AS DOUBLE) AS seconds FROM u GROUP BY host)"""


@query(
    rf"""WITH {SQL_RULES}, e AS (SELECT u.*, hs.status, CASE WHEN hs.status IS NOT NULL THEN hs.seconds END AS seconds,
  (SELECT bool_or(r.allow) FROM ru r WHERE r.host = u.host AND starts_with(u.path, r.prefix) AND length(r.prefix) = (SELECT max(length(q.prefix)) FROM ru q WHERE q.host = u.host AND starts_with(u.path, q.prefix))) AS rule FROM u JOIN hs ON hs.host = u.host)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') OR host = '' THEN 'unsupported_scheme' WHEN d % 19 = 0 THEN 'userinfo_blocked' WHEN d % 5 = 0 THEN CASE WHEN {SQL_CLOSED}[d % {len(LITERALS)} + 1] THEN 'private_address_blocked' ELSE 'robots_denied' END
  WHEN status = 404 OR (status < 400 AND coalesce(rule, true)) THEN 'ok' ELSE 'robots_denied' END AS verdict, CASE WHEN d % 19 <> 0 AND d % 5 = 0 THEN NULL ELSE seconds END AS seconds FROM e"""
)
def p23_checked_urls(spark, sf):
    """S-36, P-23, Y-44, Y-45: pages' URLs, some with users and literal addresses, against rules made of the paths of each host."""
    pages = table(spark, sf, "pages").where("url is not null and html is not null")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    u = pages.select("page_id", "url", text.host(F.col("url")).alias("host"), path.alias("path"), F.length("html").alias("n"), F.conv(F.left(F.md5("html"), F.lit(4)), 16, 10).cast("int").alias("d"))
    kinds = u.withColumn("k", F.col("n") % 4).groupBy("host").pivot("k", [0, 1, 2]).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    told = u.groupBy("host").agg((F.max("n") % 7).alias("seconds"), (F.min("n") % 9).alias("m"))
    line = lambda what, c, k: F.concat(F.lit(what), F.left(F.col(c), F.lit(k)), F.lit(" # made"))
    said = F.array(
        F.lit("Disallow: /"), F.lit("User-agent: other"), F.lit("Disallow: /"), F.lit(""), F.lit("# rules for all"), F.lit("User-agent: nobody"), F.lit("user-agent: *"), line("Allow: ", "0_lo", 4), line("Disallow: ", "0_hi", 3), line("Disallow: ", "1_hi", 3), line("Allow: ", "1_hi", 6), line("Disallow: ", "2_lo", 5),
        F.concat(F.lit("Crawl-delay: "), F.col("seconds").cast("string")), F.lit("Sitemap: /s"),
    )
    lines = kinds.join(told, "host").select("host", F.posexplode(said).alias("line_no", "line")).where("line is not null")
    status = told.select("host", F.when(F.col("m") == 0, 404).when(F.col("m") == 1, 403).when(F.col("m") == 2, None).otherwise(200).alias("status")).where("status is not null")
    literal = F.element_at(F.array(*(F.lit(x) for x, _ in LITERALS)), (F.col("d") % len(LITERALS) + 1).cast("int"))
    rest = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)(.*)$", 3)
    scheme = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    asked = F.when(F.col("d") % 19 == 0, F.concat(scheme, F.lit("me:x@"), F.col("host"), rest)).when(F.col("d") % 5 == 0, F.concat(scheme, literal, F.lit(":8080"), rest)).otherwise(F.col("url"))
    return access.checked(u.select(F.col("page_id"), asked.alias("url")), access.rules_of(lines, "folio"), status, key="page_id")

"""Queries of page structure, with SQL over the same intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import structure
from folioforge.plans.registry import query
from folioforge.plans.views import table

VOIDS = ", ".join(f"'{v}'" for v in structure.VOID)
SQL_TOKENS = rf"""h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g') AS html FROM pages),
x AS (SELECT page_id, regexp_extract_all(html, '(?s)<[^>]*>|[^<]+') AS t FROM h), e AS (SELECT page_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM x),
n AS (SELECT *, lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM e),
k AS (SELECT *, CASE WHEN NOT starts_with(token, '<') THEN 'text' WHEN tag = '' THEN 'other' WHEN starts_with(token, '</') THEN 'end' WHEN tag IN ({VOIDS}) OR ends_with(token, '/>') THEN 'void' ELSE 'start' END AS kind FROM n),
a AS (SELECT *, sum(CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS after FROM k WHERE kind <> 'other'),
tok AS (SELECT *, CASE WHEN kind = 'start' THEN after ELSE after + 1 END AS depth FROM a)"""


def _tokens(spark, sf):
    return structure.tokens(table(spark, sf, "pages").select("page_id", "html"))


@query(
    rf"""WITH {SQL_TOKENS}, s AS (SELECT *, nullif(regexp_extract(token, '(?is)\sclass\s*=\s*"([^"]*)"', 1), '') AS c FROM tok WHERE kind = 'start'),
up AS (SELECT l.page_id, l.pos, l.tag, l.c, l.depth, j FROM s l, range(0, 4) t(j) WHERE l.tag = 'a' AND l.depth - j > 0),
f AS (SELECT up.page_id, up.pos, up.j, (SELECT arg_max(CASE WHEN p.c IS NULL THEN '' ELSE p.tag || '.' || replace(p.c, ' ', '.') END, p.pos) FROM s p WHERE p.page_id = up.page_id AND p.depth = up.depth - up.j AND p.pos <= up.pos) AS name FROM up),
b AS (SELECT page_id, pos, coalesce(arg_min(name, j) FILTER (name <> ''), 'a') AS signature FROM f GROUP BY page_id, pos)
SELECT page_id, signature, count(*) AS n FROM b GROUP BY ALL"""
)
def y41_selector_signatures(spark, sf):
    """Y-39, Y-41: links of a page by the nearest element with a class."""
    return structure.signature(_tokens(spark, sf)).groupBy("page_id", "signature").agg(F.count("*").alias("n"))


@query(
    rf"""WITH {SQL_TOKENS}, c AS (SELECT page_id, min(pos) AS pos, arg_min(depth, pos) AS depth FROM tok WHERE kind = 'start' AND tag = 'nav' GROUP BY page_id),
z AS (SELECT c.page_id, c.pos, min(t.pos) AS stop FROM c LEFT JOIN tok t ON t.page_id = c.page_id AND t.pos > c.pos AND t.after < c.depth GROUP BY ALL),
w AS (SELECT z.page_id, trim(regexp_replace(string_agg(token, ' ' ORDER BY t.pos), '[\s\p{{Z}}]+', ' ', 'g')) AS text FROM z JOIN tok t ON t.page_id = z.page_id AND t.pos > z.pos AND (z.stop IS NULL OR t.pos < z.stop) AND t.kind = 'text' GROUP BY z.page_id),
p AS (SELECT page_id, list_filter(list_transform(string_split_regex(text, '[>»→/›]'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'the') AS parts FROM w)
SELECT page_id, array_to_string(parts, chr(10)) AS parts FROM p WHERE len(parts) > 0"""
)
def u08_breadcrumbs(spark, sf):
    """U-08: the parts of the first navigation element."""
    return structure.breadcrumbs(_tokens(spark, sf), r"^nav\.", ("the",)).select("page_id", F.array_join("parts", "\n").alias("parts"))


@query(
    rf"""WITH {SQL_TOKENS}, u AS (SELECT page_id, pos, tag, tag <> 'a' AS embedded, trim(CASE WHEN tag = 'a' THEN regexp_extract(token, '(?is)\shref\s*=\s*"([^"]*)"', 1) WHEN tag IN ('iframe', 'embed') THEN regexp_extract(token, '(?is)\ssrc\s*=\s*"([^"]*)"', 1) WHEN tag = 'object' THEN regexp_extract(token, '(?is)\sdata\s*=\s*"([^"]*)"', 1) END) AS url FROM tok WHERE kind IN ('start', 'void'))
SELECT * FROM u WHERE url <> '' AND NOT regexp_matches(url, '(?i)^(#|javascript:|mailto:|tel:)')"""
)
def u04_resource_links(spark, sf):
    """U-04: anchors, frames and embedded objects."""
    return structure.resource_links(_tokens(spark, sf))

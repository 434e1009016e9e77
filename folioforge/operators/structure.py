"""The structure of stored pages as rows: tags and texts in order with a running depth, ancestors by interval, all with built-ins.

A start tag opens an interval at its depth; it ends before the first later place whose depth is smaller. So the ancestor of a place at a
given depth is the last start tag of that depth before it, whatever lies between. Broken nesting has a defined meaning: an end tag
closes the innermost open element whatever its name, an element without end tag lasts until something closes it, and end tags too many
lead to depths below zero, which have no ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import collapse

#: Elements without content, and what separates the parts of a breadcrumb.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
SEPARATORS = "[>»→/›]"
#: Containers of breadcrumbs, by ``tag.class#id`` in lower case.
BREADCRUMB = r"breadcrumb|crumb|\.position|\.location|\.path"
HIDDEN = (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>")


def attribute(token: Column, name: str) -> Column:
    """The value of an attribute in double quotes, else in single quotes, else an empty text."""
    quoted = lambda q: F.regexp_extract(token, rf"(?is)\s{name}\s*=\s*{q}([^{q}]*){q}", 1)
    return F.coalesce(F.nullif(quoted('"'), F.lit("")), quoted("'"))


def tokens(pages: DataFrame) -> DataFrame:
    """``page_id, pos, token, tag, kind, depth, after``: start, void, end tags and texts of ``page_id, html`` in order.

    ``after`` is the number of elements that are open behind the token; ``depth`` that of the token itself (children of one element share it). Comments, scripts and
    styles are left out, as are declarations. Null pages have no rows. A page is one window, which spills.
    """
    html = F.col("html")
    for p in HIDDEN:
        html = F.regexp_replace(html, p, "")
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)(<[^>]*>|[^<]+)"), F.lit(1))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    kind = F.when(~F.col("token").startswith("<"), "text").when(F.col("tag") == "", "other").when(F.col("token").startswith("</"), "end").when(F.col("tag").isin(*VOID) | F.col("token").endswith("/>"), "void").otherwise("start")
    rows = rows.withColumn("tag", tag).withColumn("kind", kind).where("kind <> 'other'")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    rows = rows.withColumn("after", F.sum(step).over(Window.partitionBy("page_id").orderBy("pos")))
    return rows.withColumn("depth", F.when(F.col("kind") == "start", F.col("after")).otherwise(F.col("after") + 1))


def signature(rows: DataFrame, tag: str = "a", levels: int = 4) -> DataFrame:
    """``page_id, pos, signature`` of every ``tag``: name and classes of the nearest of ``levels`` elements, itself first, that has a class; else its name.

    ``rows`` are :func:`tokens`. Ancestors are last values in windows of one page and depth.
    """
    classes = F.regexp_replace(F.trim(F.regexp_replace(attribute(F.col("token"), "class"), r"\s+", " ")), " ", ".")
    named = F.when(classes != "", F.concat("tag", F.lit("."), classes))
    starts = rows.where("kind = 'start'").select("page_id", "pos", "depth", "tag", named.alias("named"))
    mine = starts.where(F.col("tag") == tag)
    asks = mine.select("page_id", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))).alias("up"), "pos", F.col("depth")).select("page_id", (F.col("depth") - F.col("up")).alias("depth"), "pos", "up", F.lit(None).cast("struct<named:string>").alias("given"))
    gives = starts.select("page_id", "depth", "pos", F.lit(None).cast("int").alias("up"), F.struct("named").alias("given"))
    before = Window.partitionBy("page_id", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = gives.unionByName(asks.where("depth > 0")).withColumn("above", F.last("given", ignorenulls=True).over(before)).where("up is not null and above.named is not null")
    nearest = found.groupBy("page_id", "pos").agg(F.min_by("above.named", "up").alias("above"))
    return mine.join(nearest, ["page_id", "pos"], "left").select("page_id", "pos", F.coalesce("named", "above", "tag").alias("signature"))


def container_texts(rows: DataFrame, pattern: str = BREADCRUMB) -> DataFrame:
    """``page_id, text``: the collapsed text of the first element of each page whose ``tag.class#id`` matches."""
    label = F.lower(F.concat("tag", F.lit("."), attribute(F.col("token"), "class"), F.lit("#"), attribute(F.col("token"), "id")))
    first = rows.where("kind = 'start'").where(label.rlike(pattern)).groupBy("page_id").agg(F.min(F.struct("pos", "depth")).alias("c"))
    inside = rows.join(first, "page_id").where("pos > c.pos")
    end = inside.where("after < c.depth").groupBy("page_id").agg(F.min("pos").alias("end"))
    texts = inside.where("kind = 'text'").join(end, "page_id", "left").where("end is null or pos < end")
    return texts.groupBy("page_id").agg(collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")).alias("text"))


def breadcrumbs(rows: DataFrame, pattern: str = BREADCRUMB, drop: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, parts``: the parts of a page's breadcrumb without blanks and the words of ``drop``; pages without any part have no row."""
    parts = F.filter(F.transform(F.split("text", SEPARATORS), lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).isin(*drop))
    return container_texts(rows, pattern).select("page_id", parts.alias("parts")).where("size(parts) > 0")


def resource_links(rows: DataFrame) -> DataFrame:
    """``page_id, pos, tag, url, embedded``: links of anchors and of embedded frames and objects, those within the page and of other schemes left out."""
    url = F.when(F.col("tag") == "a", attribute(F.col("token"), "href")).when(F.col("tag").isin("iframe", "embed"), attribute(F.col("token"), "src")).when(F.col("tag") == "object", attribute(F.col("token"), "data"))
    found = rows.where("kind in ('start', 'void')").select("page_id", "pos", "tag", F.trim(url).alias("url"), (F.col("tag") != "a").alias("embedded"))
    return found.where("url <> ''").where(~F.col("url").rlike("(?i)^(#|javascript:|mailto:|tel:)"))

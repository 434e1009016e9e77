"""Links, titles and text of stored pages, in JVM regular expressions; a parser is a plug-in where structure matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import collapse, strip
from folioforge.operators.retrieval import small

ANCHOR = r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, pos, href, anchor`` of all anchors in page order."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("anchor"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("pos", "l"))
    return rows.select("page_id", "pos", F.col("l.href").alias("href"), collapse(F.regexp_replace("l.anchor", "<[^>]*>", " ")).alias("anchor"))


def title_segments(html: F.Column) -> F.Column:
    """Parts of the title element, cut at bars, stripped, without empty ones."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.filter(F.transform(F.split(raw, r"[|｜]"), collapse), lambda x: x != "")


def plain_text(html: F.Column) -> F.Column:
    """Text without scripts, styles, comments and tags, white space collapsed."""
    for pattern in (r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return collapse(html)


#: Scores of attachment evidence and the least total that makes a candidate.
EXTENSION, DOWNLOAD, ANCHOR_WORD, PATH = 0.5, 0.3, 0.3, 0.3
LEAST = 0.5


def attachment_candidates(links: DataFrame, most: int = 20) -> DataFrame:
    """Links scored as attachments, one row per (page_id, href) with its best score and first nonempty anchor, at most ``most`` a page."""
    href = F.lower("href")
    score = (
        F.when(href.rlike(r"\.(pdf|docx?|xlsx?|pptx?|zip|rar)([?#].*)?$"), EXTENSION).otherwise(0.0)
        + F.when(href.contains("download"), DOWNLOAD).otherwise(0.0)
        + F.when(F.lower("anchor").rlike("附件|下载|download|attachment"), ANCHOR_WORD).otherwise(0.0)
        + F.when(href.rlike("/(upload|uploads|attach|files?)/"), PATH).otherwise(0.0)
    )
    scored = links.withColumn("score", F.round(score, 6)).where(F.col("score") >= LEAST)
    merged = scored.groupBy("page_id", "href").agg(F.max("score").alias("score"), F.min_by(F.col("anchor"), F.when(F.col("anchor") != "", F.col("pos"))).alias("anchor"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= most).drop("pos")


def drop_repeated_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """Text without lines equal to the line before them."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.element_at(lines, F.greatest(i, F.lit(1)))))
    return rows.withColumn(text, F.array_join(kept, "\n"))


def match_accounts(articles: DataFrame, accounts: DataFrame) -> DataFrame:
    """Articles with the ``account_id`` whose name or alias equals their stripped ``account``; null without one.

    ``accounts`` has account_id, account_name, aliases, enabled and position; of several, the first in position counts.
    """
    named = F.explode(F.concat(F.array("account_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name")
    known = accounts.where("coalesce(enabled, true)").select(named, "account_id", "position").where("_name != ''")
    known = known.groupBy("_name").agg(F.min_by("account_id", "position").alias("account_id"))
    return articles.join(small(known, 10_000), strip(F.col("account")) == F.col("_name"), "left").drop("_name")

"""Ingest of crawled articles and their attachments as decisions, manifest rows and relations.

Every row gets one action: ``unchanged``, ``quarantined``, ``kept_previous``, ``rejected``, ``archived``, ``new``, ``updated`` or
``relation_only``. Articles do not depend on each other; attachments depend on their order through the first one of a file and of a
URL, which are minima by key, never windows over a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.rules import cascade
from folioforge.functions.text import squash, text_hash
from folioforge.operators.joins import join_unique
from folioforge.storage import cut

#: Kinds that a page without a declared kind may not push aside while its text is the same.
WEAK_KINDS = ("incomplete", "news", "event", "promotion")
#: Sources whose service phones and public contacts are let through.
PHONE_SOURCES = ("official_department", "information_disclosure", "service_platform", "official_wechat")
CONTACT_SOURCES = ("official_department", "official_college", "official_wechat", "information_disclosure", "service_platform")
MANIFEST = ("doc_id", "title", "source_url", "publish_date", "document_type", "document_kind", "quality_status", "content_hash", "text_hash", "binary_hash", "file_path", "retention_status", "parent_doc_id")


def article_body(title: Column, body: Column) -> Column:
    """The stored form of an article."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n"))


def file_path(category: Column, title: Column, content_hash: Column, old_path: Column) -> Column:
    """Where a body is stored: its old place, else below its category by name and the last six characters of its hash."""
    name = F.left(F.regexp_replace(F.lower(title), r"(?U)[^\w]+", "-"), F.lit(40))
    return F.coalesce(F.nullif(old_path, F.lit("")), F.concat(category, F.lit("/"), name, F.lit("-"), F.right(content_hash, F.lit(6)), F.lit(".md")))


def kept_kind(kind: Column, hint: Column, same_text: Column, old_kind: Column) -> Column:
    """The declared kind, else the found one, unless it is weak and the same text has a better kind already."""
    weaker = same_text & kind.isin(*WEAK_KINDS) & ~old_kind.isin(*WEAK_KINDS)
    return F.coalesce(F.nullif(hint, F.lit("")), F.when(F.coalesce(weaker, F.lit(False)), old_kind).otherwise(kind))


def _known(existing: DataFrame) -> DataFrame:
    old = [F.col(c).alias(f"old_{c}") for c in ("quality_status", "content_hash", "text_hash", "binary_hash", "file_path", "document_kind")]
    return existing.select("doc_id", *old)


def ingest_articles(articles: DataFrame, existing: DataFrame) -> DataFrame:
    """Articles with ``document_kind`` as kept, ``content_hash``, ``text_hash``, ``file_path``, ``action``, ``reason`` and ``writes`` (whether the manifest gets a row).

    ``articles``: doc_id, status (ok, not_modified or a failure), title, body, category, kind, hint, sensitive, quality (accepted or why not), quality_reason,
    retention (active, historical, archived), retention_reason. ``existing``: the folded manifest, one row a doc_id. Fetches that failed get no action and change nothing;
    refused pages keep an accepted earlier version. Null texts count as empty. Rows that repeat a doc_id are judged alike, each by itself.
    """
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    rows = articles.join(_known(existing), "doc_id", "left").withColumn("text_hash", text_hash(squash(body))).withColumn("content_hash", text_hash(article_body(title, body)))
    stored = F.coalesce((F.col("old_quality_status") == "accepted") & (F.col("old_content_hash") != "") & (F.col("old_file_path") != ""), F.lit(False))
    same_text = stored & (F.col("old_text_hash") == F.col("text_hash"))
    kept = (F.col("old_quality_status") == "accepted") & (F.col("old_content_hash") != "")
    same = (F.col("old_content_hash") == F.col("content_hash")) & (F.col("old_file_path") != "")
    steps = [
        (F.col("status") == "not_modified", "unchanged", F.lit("not_modified")),
        (F.coalesce(F.col("status") != "ok", F.lit(True)), None, F.lit(None)),
        (F.col("sensitive"), "quarantined", F.lit("sensitive")),
        ((F.col("quality") != "accepted") & kept, "kept_previous", F.col("quality")),
        (F.col("quality") != "accepted", "rejected", F.coalesce(F.nullif("quality_reason", F.lit("")), "quality")),
        (F.col("retention") == "archived", "archived", F.col("retention_reason")),
        (same, "unchanged", F.lit("")),
        (F.col("old_quality_status").isNotNull(), "updated", F.lit("")),
    ]
    action, reason = F.lit("new"), F.lit("")
    for condition, name, why in reversed(steps):
        hit = F.coalesce(condition, F.lit(False))
        action, reason = F.when(hit, F.lit(name)).otherwise(action), F.when(hit, why.cast("string")).otherwise(reason)
    rows = rows.withColumn("document_kind", kept_kind(F.col("kind"), F.coalesce("hint", F.lit("")), same_text, F.col("old_document_kind"))).withColumn("action", action).withColumn("reason", reason)
    stores = F.col("action").isin("new", "updated")
    refused = F.col("action").isin("quarantined", "rejected")
    path = F.when(stores, file_path(F.coalesce("category", F.lit("")), title, F.col("content_hash"), F.col("old_file_path"))).when(F.col("action") == "unchanged", F.col("old_file_path")).otherwise("")
    rows = rows.withColumn("file_path", path).withColumn("document_kind", F.when(refused, "incomplete").otherwise(F.col("document_kind")))
    moved = (F.col("action") == "unchanged") & (F.col("status") == "ok") & (F.col("document_kind") != F.col("old_document_kind"))
    return rows.withColumn("content_hash", F.when(stores | (F.col("action") == "unchanged"), F.col("content_hash")).otherwise("")).withColumn("writes", F.coalesce(stores | refused | (F.col("action") == "archived") | moved, F.lit(False)))


def manifest_rows(decided: DataFrame) -> DataFrame:
    """The rows that :func:`ingest_articles` or :func:`ingest_attachments` append to the manifest."""
    status = F.when(F.col("action") == "quarantined", "quarantined").when(F.col("action") == "rejected", F.col("quality")).otherwise("accepted")
    have = {"quality_status": status, "retention_status": F.when(F.col("action").isin("quarantined", "rejected"), F.lit("")).otherwise(F.col("retention"))}
    known = [have.get(c, F.col(c) if c in decided.columns else F.lit("")).alias(c) for c in MANIFEST]
    return decided.where("writes").select(*known)


def dropped_files(decided: DataFrame) -> DataFrame:
    """``(doc_id, file_path)`` of stored bodies whose page is refused now: the index and the store forget them."""
    return decided.where(F.col("action").isin("quarantined", "rejected") & (F.coalesce("old_file_path", F.lit("")) != "")).select("doc_id", F.col("old_file_path").alias("file_path")).distinct()


def ingest_attachments(attachments: DataFrame, parents: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attachments with ``action``, ``reason`` and the fields of :func:`ingest_articles`, and the relations ``(parent_doc_id, child_doc_id)``.

    ``attachments``: seq (order, no repeats), parent_doc_id, doc_id, binary_hash, name, parse_status, text, stored_text, category, sensitive, kind, retention, retention_reason.
    ``parents``: doc_id and action; attachments of quarantined, failed and unmodified parents are left out. A file that an earlier row had under another URL, and a URL that an earlier row had, only adds a relation to
    that first one. Quarantined files get no relation; files that cannot be parsed keep an accepted earlier version. Null hashes are nobody's copy.
    """
    live = parents.where("action is not null and action <> 'quarantined' and coalesce(reason, '') <> 'not_modified'").select(F.col("doc_id").alias("parent_doc_id")).distinct()
    rows = cut(attachments.join(live, "parent_doc_id", "left_semi"), "attachments")
    by_file = cut(rows.where("binary_hash is not null").groupBy("binary_hash").agg(F.min_by("doc_id", "seq").alias("canonical"), F.count("*").alias("n")), "first_of_file")
    filed = join_unique(rows, by_file, "binary_hash", "n").drop("n").unionByName(rows.where("binary_hash is null").withColumn("canonical", F.col("doc_id")))
    own = F.col("doc_id") == F.col("canonical")
    filed = cut(filed, "filed")
    by_url = cut(filed.where(own).groupBy("doc_id").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")), "first_of_url")
    first = join_unique(filed.where(own), by_url, "doc_id", "n").drop("n")
    text = F.coalesce("text", F.lit(""))
    out = first.join(_known(existing), "doc_id", "left").unionByName(filed.where(~own), allowMissingColumns=True)
    out = out.withColumn("text_hash", F.when(text != "", text_hash(squash(text))).otherwise("")).withColumn("content_hash", text_hash(F.coalesce("stored_text", F.lit(""))))
    accepted = F.coalesce(F.col("old_quality_status") == "accepted", F.lit(False))
    unread = (F.coalesce("parse_status", F.lit("unparsed")) != "ok") | (text == "")
    stored = F.coalesce(F.col("old_file_path") != "", F.lit(False))
    rules = [
        (F.col("doc_id") != F.col("canonical"), "relation_only", "same_file"),
        (F.col("seq") > F.col("first_seq"), "relation_only", "same_url"),
        (unread & accepted, "kept_previous", "unread"),
        (unread, "rejected", "unread"),
        (F.coalesce("sensitive", F.lit(False)), "quarantined", "sensitive"),
        (F.col("retention") == "archived", "archived", "archived"),
        (stored & (F.col("old_binary_hash") == F.col("binary_hash")) & (F.col("old_content_hash") == F.col("content_hash")), "unchanged", ""),
        (stored & accepted & (F.col("old_text_hash") == F.col("text_hash")), "unchanged", "same_text"),
        (F.col("old_quality_status").isNotNull(), "updated", ""),
    ]
    guarded = [(F.coalesce(c, F.lit(False)), a, r) for c, a, r in rules]
    out = out.withColumn("action", cascade([(c, a) for c, a, _ in guarded], "new")).withColumn("reason", cascade([(c, r) for c, _, r in guarded], ""))
    stores = F.col("action").isin("new", "updated")
    path = F.when(stores, file_path(F.coalesce("category", F.lit("")), F.coalesce("name", F.lit("")), F.col("content_hash"), F.col("old_file_path"))).when(F.col("action") == "unchanged", F.col("old_file_path")).otherwise("")
    out = out.withColumn("file_path", path).withColumn("content_hash", F.when(F.col("file_path") != "", F.col("content_hash")).otherwise(""))
    out = out.withColumn("writes", stores | F.col("action").isin("rejected", "quarantined", "archived") | ((F.col("action") == "unchanged") & (F.col("reason") == "same_text")))
    relations = out.where("action <> 'quarantined' and parent_doc_id is not null").select("parent_doc_id", F.col("canonical").alias("child_doc_id")).distinct()
    return out, relations

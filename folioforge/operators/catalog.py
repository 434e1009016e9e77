"""The document catalog: an append-only log folded into current state, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.rules import ENDURING_KINDS, collection_of, temporal_class
from folioforge.functions.text import document_key, host, iso_date, school_year, strip


def fold(log: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The last row of every key, with ``first_seq``: values are last-wins, positions first-wins."""
    w = Window.partitionBy(key)
    return log.withColumn("first_seq", F.min(seq).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(seq)))).where("_r = 1").drop("_r")


def history(log: DataFrame, keep: int = 20, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The newest ``keep`` versions of every key with ``version`` (1 is newest) and ``is_current``."""
    ranked = log.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq))))
    return ranked.where(F.col("version") <= keep).withColumn("is_current", F.col("version") == 1)


def previous_where(log: DataFrame, condition: F.Column, value: str, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Every row with the latest earlier ``value`` of its key for which the condition held."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("previous", F.last(F.when(condition, F.col(value)), ignorenulls=True).over(w))


def append_new(existing: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of ``more`` that ``existing`` lacks, once each, compared on all columns null-safely."""
    more = more.select(*existing.columns).distinct()
    same = [existing[c].eqNullSafe(more[c]) for c in existing.columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return more.join(existing, on, "left_anti")


def duplicate_groups(docs: DataFrame, digest: str) -> DataFrame:
    """Hashes that several documents share, with their number and smallest id."""
    return docs.groupBy(digest).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def duplicate_rate(docs: DataFrame, digest: str) -> DataFrame:
    per = docs.groupBy(digest).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") - 1).alias("n_duplicates"), (F.sum(F.col("n") - 1) / F.sum("n")).alias("rate"))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


WINDOWS = {"recent_5_school_years": 4, "recent_2_school_years": 1, "current_school_year": 0}


def retention(docs: DataFrame, evaluated: str) -> DataFrame:
    """Adds ``temporal_class, retention, reason`` from document_kind, publish_date and time_policy.

    Isolated kinds are archived; then the policies archive_only and all_history decide; enduring kinds stay active;
    others need a date that is neither in the future nor older than the policy's number of school years.
    """
    kind, policy = F.col("document_kind"), F.col("time_policy")
    day = iso_date(F.col("publish_date"))
    age = school_year(F.to_date(F.lit(evaluated))) - school_year(day)
    limit = F.coalesce(*(F.when(policy == p, n) for p, n in WINDOWS.items()))
    rules = [
        (kind.isin("news", "event", "promotion", "incomplete"), "archived", F.lit("isolated_document_kind")),
        (policy == "archive_only", "archived", F.lit("archive_only")),
        (policy == "all_history", "active", F.lit("all_history")),
        (kind.isin(*ENDURING_KINDS), "active", F.lit("enduring_document")),
        (day.isNull(), "archived", F.lit("missing_publish_date_for_time_policy")),
        (age < 0, "archived", F.lit("future_publish_date")),
        (age > limit, "archived", F.concat(F.lit("outside_"), policy)),
    ]
    state, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for condition, s, r in rules[1:]:
        state, reason = state.when(condition, s), reason.when(condition, r)
    return docs.withColumn("temporal_class", temporal_class(kind)).withColumn("retention", state.otherwise("active")).withColumn("reason", reason.otherwise(policy))


def canonical_annual(docs: DataFrame) -> DataFrame:
    """One active document for each annual series: dated first, then latest, then largest id; the others become historical."""
    live = (F.col("temporal_class") == "annual") & (F.col("retention") == "active")
    day = iso_date(F.col("publish_date"))
    w = Window.partitionBy(live, F.when(live, F.col("series_key")).otherwise(F.col("doc_id").cast("string"))).orderBy(day.desc_nulls_last(), F.desc("doc_id"))
    top = F.first("doc_id").over(w)
    older = live & (F.col("_top") != F.col("doc_id"))
    return (
        docs.withColumn("_top", top)
        .withColumn("canonical_doc_id", F.when(live, F.col("_top")))
        .withColumn("reason", F.when(older, "prior_annual_series_version").otherwise(F.col("reason")))
        .withColumn("retention", F.when(older, "historical").otherwise(F.col("retention")))
        .drop("_top")
    )


#: What a series key drops from titles, in this order.
SERIES_DROPS = (
    r"(?i)\.(?:pdf|docx?|xlsx?|pptx?)$", r"(?:19|20)\d{2}\s*[-—至到/]\s*(?:19|20)\d{2}\s*学年", r"(?:19|20)\d{2}\s*(?:年度|年)", r"第\s*[一二三四五六七八九十百0-9]+\s*批",
    r"第?\s*\d+\s*(?:[-—至到]\s*\d+)?\s*周", r"^(?:关于)", r"(?:的通知|通知|公告)$", r"(?U)[\s_·•]+", r"^[-—:：,，。()（）\[\]【】]+|[-—:：,，。()（）\[\]【】]+$",
)


def series_part(c: F.Column, default: str) -> F.Column:
    for pattern in SERIES_DROPS:
        c = F.regexp_replace(c, pattern, "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def series_key(title: F.Column, publisher: F.Column, scope: F.Column) -> F.Column:
    """publisher|scope|title without years, batches and weeks. Titles are taken to be in NFKC form."""
    return F.concat_ws("|", series_part(publisher, "unknown-publisher"), series_part(scope, "all"), series_part(title, "unknown-series"))


def with_parent(docs: DataFrame) -> DataFrame:
    """Adds the parent's title to attachments; the first title of each document counts."""
    titles = docs.groupBy("doc_id").agg(F.min("title").alias("parent_title")).withColumnRenamed("doc_id", "parent_doc_id")
    return docs.join(titles, "parent_doc_id", "left").withColumn("parent_title", F.coalesce("parent_title", F.lit("")))


def index_changes(present: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, change`` from (doc_id, embedding_signature, metadata_signature) of both sides: added, deleted, updated, metadata_only, unchanged."""
    a, b = present.toDF("doc_id", "e0", "m0"), wanted.toDF("doc_id", "e1", "m1")
    change = F.when(F.col("e0").isNull(), "added").when(F.col("e1").isNull(), "deleted").when(F.col("e0") != F.col("e1"), "updated").when(F.col("m0") != F.col("m1"), "metadata_only").otherwise("unchanged")
    return a.join(b, "doc_id", "full").select("doc_id", change.alias("change"))


def title_of(text: F.Column) -> F.Column:
    return strip(F.split(text, "\n", 2)[0])


def parent_domains(docs: DataFrame) -> DataFrame:
    """``doc_id, domain``: the host of the parent's ``url``, for documents whose parent is in the catalog."""
    child = docs.where("parent_doc_id is not null").select("doc_id", "parent_doc_id")
    parent = docs.select(F.col("doc_id").alias("parent_doc_id"), host(F.col("url")).alias("domain"))
    return child.join(parent, "parent_doc_id").select("doc_id", "domain")


def valid_topics(docs: DataFrame, by: str, kinds: tuple[str, ...] = ("policy", "procedure", "annual_notice")) -> DataFrame:
    """Distinct topics of accepted documents by group: the topic key, else the policy's name, else the title."""
    name = F.coalesce(F.nullif("topic_key", F.lit("")), F.nullif("policy_name", F.lit("")), F.col("title"))
    return docs.where((F.col("quality_status") == "accepted") & F.col("document_kind").isin(*kinds)).groupBy(by).agg(F.count_distinct(name).alias("topics"))


def unmatched_keys(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that only one side has, with ``side``. Empty where a rebuild may go on."""
    marked = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = marked.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l != r")
    return sides.select(key, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def retained_by_parent(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """``docs`` where archived attachments of a sound kind take over the lifecycle of their best parent.

    Active parents lead historical ones, then the later date and the larger doc_id count. ``edges`` has
    parent_doc_id and child_doc_id. Only attachments that change are joined back.
    """
    order = lambda status: F.when(status == "active", 2).when(status == "historical", 1).otherwise(0)
    parent = docs.select(
        F.col("doc_id").alias("parent_doc_id"),
        F.struct(order(F.col("retention_status")).alias("o"), "publish_date", "doc_id", F.col("retention_status").alias("status"), F.col("series_key").alias("series"), F.coalesce("canonical_doc_id", "doc_id").alias("canonical")).alias("p"),
    )
    best = edges.select("parent_doc_id", "child_doc_id").join(parent, "parent_doc_id").groupBy(F.col("child_doc_id").alias("doc_id")).agg(F.max("p").alias("p"))
    joined = docs.join(best, "doc_id", "left")
    fits = (F.col("document_type") == "attachment") & (F.col("document_kind") != "incomplete") & (F.col("quality_status") == "accepted") & (F.col("retention_status") == "archived")
    moves = F.coalesce(fits & (F.col("p.o") > 0) & collection_of(F.col("document_kind"), F.col("p.status")).isNotNull(), F.lit(False))
    new = {"series_key": F.col("p.series"), "retention_status": F.col("p.status"), "retention_reason": F.lit("retained_by_parent_relation"), "canonical_doc_id": F.col("p.canonical")}
    return joined.select(*(F.when(moves, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in docs.columns))


def explains(articles: DataFrame, docs: DataFrame, official: tuple[str, ...]) -> DataFrame:
    """Relations of articles to the official document that they explain: ``parent, child, evidence, confidence``.

    A named URL decides; without one, a topic with exactly one active official policy does. ``articles`` has
    doc_id and related_url, ``docs`` the catalog with topic_key; keys are text.
    """
    named = F.coalesce(strip(F.col("related_url")), F.lit("")) != ""
    by_url = articles.where(named).select(document_key(strip(F.col("related_url"))).alias("parent"), F.col("doc_id").alias("child"), F.lit("seed related_official_url").alias("evidence"), F.lit(1.0).alias("confidence"))
    policy = docs.where(F.col("source_type").isin(*official) & (F.col("document_kind") == "policy") & (F.col("quality_status") == "accepted") & (F.col("retention_status") == "active"))
    policy = policy.where("topic_key != '' and topic_key != 'unknown.topic'").groupBy("topic_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("parent")).where("n = 1")
    topics = articles.where(~named).select("doc_id").join(docs.select("doc_id", "topic_key"), "doc_id").join(policy, "topic_key").where("parent != doc_id")
    return by_url.union(topics.select("parent", F.col("doc_id").alias("child"), F.concat(F.lit("topic_key 唯一匹配: "), "topic_key").alias("evidence"), F.lit(0.7).alias("confidence")))


def allow_list_changes(allowed: DataFrame, found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``key, change``: allowed entries that were not found are ``missing``, stored ones no longer allowed ``revoked``."""
    gone = lambda a, b, change: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("change", F.lit(change))
    return gone(allowed, found, "missing").union(gone(stored, allowed, "revoked"))


def index_canonical(docs: DataFrame, by: str) -> DataFrame:
    """The document that stands for each group of two or more: current first, then date, length, attachments, doc_id."""
    order = F.struct((F.col("validity_status") == "current").alias("c"), "publish_date", F.length("text").alias("l"), F.col("is_attachment"), "doc_id")
    return docs.groupBy(by).agg(F.count("*").alias("n"), F.max(order)["doc_id"].alias("canonical_doc_id")).where("n > 1")


def published(evidence: DataFrame, sure: float = 0.9) -> DataFrame:
    """The date of each document by priority and position, and whether sure pieces of evidence disagree."""
    told = F.when(F.col("confidence") >= sure, F.col("date"))
    return evidence.groupBy("doc_id").agg(F.min_by("date", F.struct("priority", "pos")).alias("date"), F.coalesce(F.min(told) != F.max(told), F.lit(False)).alias("conflict"))

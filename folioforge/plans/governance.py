"""Queries of reports, resolutions, guards and administration, with their SQL. Names begin with the handle of the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import rules, text
from folioforge.operators import reports, versions
from folioforge.plans import views
from folioforge.plans.registry import query
from folioforge.plans.views import SQL_CATALOG, table

COLLECTION = "CASE WHEN document_kind IN ('policy','procedure','annual_notice','form','manual','service_guide') AND {r} = 'historical' THEN 'historical' WHEN {r} <> 'active' THEN NULL WHEN document_kind IN ('policy','procedure','faq','annual_notice','form','manual','service_guide') THEN 'main_qa' WHEN document_kind = 'public_list' THEN 'public_list' END"


def _id() -> F.Column:
    return F.col("doc_id")


def _pick(values: tuple) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (_id() % len(values) + 1).cast("int"))


def _sql(values: tuple, of: str = "doc_id") -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"][({of}) % {len(values)} + 1]"


STATUSES = ("answered", "refused", "answered", "error", "citation_issue")


@query(f"SELECT {_sql(STATUSES)} AS status, count(*) AS n FROM documents GROUP BY 1")
def a12_status_counts(spark, sf):
    return reports.status_counts(table(spark, sf, "documents").select(_pick(STATUSES).alias("status")))


REASONS = ("", "news_noise", "duplicate", "too_short", "no_facts", "duplicate_text_hash")


@query(
    f"""WITH d AS (SELECT coalesce(nullif({_sql(('admission', '', 'exam'))}, ''), '其他') AS topic, doc_id % 4 = 0 AS ok, {_sql(REASONS)} AS reason, doc_id % 8 = 0 AS old FROM documents)
SELECT topic, count(*) AS discovered, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND old) AS historical, count(*) FILTER (NOT ok AND reason IN ('news_noise', 'no_facts')) AS news_rejected,
  count(*) FILTER (NOT ok AND reason IN ('duplicate', 'duplicate_text_hash')) AS duplicate, count(*) FILTER (NOT ok AND reason IN ('', 'too_short')) AS other_rejected FROM d GROUP BY topic"""
)
def a14_topic_stats(spark, sf):
    rows = table(spark, sf, "documents").select(_pick(("admission", "", "exam")).alias("topic"), F.when(_id() % 4 == 0, "accept").otherwise("reject").alias("decision"), _pick(REASONS).alias("reason"), F.when(_id() % 8 == 0, "historical").alias("retention"))
    return reports.topic_stats(rows)


@query(
    """WITH r AS (SELECT source, count(*) FILTER (doc_id % 3 > 0) AS a, count(*) FILTER (doc_id % 3 = 0) AS f, avg(CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 5 > 0 THEN 1.0 ELSE 0.0 END END) AS hit,
  avg(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 > 0 THEN 1.0 ELSE 0.0 END END) AS refusal, avg(CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 11 > 0 THEN 1.0 ELSE 0.0 END END) AS answer FROM documents GROUP BY source)
SELECT source, array_to_string(list_filter([CASE WHEN hit IS NULL THEN 'no_answerable' WHEN hit < 0.8 THEN 'hit_rate' END, CASE WHEN refusal IS NULL THEN 'no_refusable' WHEN refusal < 0.85 THEN 'refusal_rate' END, CASE WHEN answer < 0.9 THEN 'answer_rate' END], lambda x: x IS NOT NULL), ',') AS failures FROM r"""
)
def p36_gate_failures(spark, sf):
    rate = lambda on, of: F.avg(F.when(on, F.when(_id() % of > 0, 1.0).otherwise(0.0)))
    r = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), rate(_id() % 3 > 0, 5).alias("hit_rate"), rate(_id() % 3 == 0, 7).alias("refusal_rate"), rate(_id() % 3 > 0, 11).alias("answer_rate"))
    return reports.gate_failures(r, 0.8, 0.85, 0.9).select("source", F.array_join("failures", ",").alias("failures"))


def _hosts(*at):
    return F.array(*(F.concat(F.lit("h"), ((_id() + k) % 7).cast("string"), F.when((_id() + k) % 5 == 0, ".other.example").otherwise(".example.org")) for k in at))


def _sql_hosts(*at):
    return "[" + ", ".join(f"'h' || ((doc_id + {k}) % 7) || CASE WHEN (doc_id + {k}) % 5 = 0 THEN '.other.example' ELSE '.example.org' END" for k in at) + "]"


@query(
    f"""WITH q AS (SELECT doc_id, {_sql_hosts(0, 1)} AS e, list_sort(list_distinct({_sql_hosts(2, 9, 3)})) AS h, doc_id % 2 = 0 AS off FROM documents), o AS (SELECT *, len(list_filter(h, lambda x: NOT suffix(x, '.example.org'))) = 0 AS ok FROM q)
SELECT doc_id, array_to_string(CASE WHEN off AND ok THEN list_sort(list_distinct(list_concat(e, h))) ELSE e END, ',') AS expected, CASE WHEN off THEN CASE WHEN ok THEN 'auto_extended' ELSE 'manual' END ELSE '' END AS review FROM o"""
)
def p30_extended_domains(spark, sf):
    made = reports.extended_domains(_hosts(0, 1), _hosts(2, 9, 3), F.when(_id() % 2 == 0, "answerable_offdomain").otherwise("answerable"), ".example.org")
    return table(spark, sf, "documents").select("doc_id", made.alias("x")).select("doc_id", F.array_join("x.expected", ",").alias("expected"), "x.review")


@query(f"WITH q AS (SELECT doc_id, list_sort(list_distinct(list_intersect({_sql_hosts(0, 1, 2)}, {_sql_hosts(2, 9, 4)}))) AS b FROM documents) SELECT doc_id, array_to_string(b, ',') AS domains, len(b) > 0 AS matched FROM q")
def o03_shared_domains(spark, sf):
    """O-03, Y-15."""
    made = reports.shared_domains(_hosts(0, 1, 2), _hosts(2, 9, 4)).alias("x")
    return table(spark, sf, "documents").select("doc_id", made).select("doc_id", F.array_join("x.domains", ",").alias("domains"), "x.matched")


@query(
    """WITH b AS (SELECT doc_id AS question_id, doc_id % 7 = 0 AS plain FROM documents), d AS (SELECT doc_id AS question_id, doc_id % 2 = 0 AS ok FROM documents WHERE doc_id % 5 <> 0)
SELECT question_id, CASE WHEN plain OR ok THEN 'grounded' ELSE 'needs_docs' END AS status, CASE WHEN plain OR ok THEN '' ELSE 'r' || question_id END AS reason FROM b JOIN d USING (question_id)"""
)
def j11_ground_bank(spark, sf):
    d = table(spark, sf, "documents")
    bank = d.select(_id().alias("question_id"), (_id() % 14 == 0).alias("should_refuse"), F.when(_id() % 14 == 7, True).alias("needs_clarification"))
    found = d.where("doc_id % 5 != 0").select(_id().alias("question_id"), F.when(_id() % 2 == 0, "grounded").otherwise("needs_docs").alias("status"), F.concat(F.lit("r"), _id().cast("string")).alias("reason"))
    return reports.ground_bank(bank, found).select("question_id", "status", "reason")


UNITS = ((1, "src1"), (1, "tion"), (2, "the"), (3, "src12"), (4, "Th"), (5, "and"), (6, "src3"), (6, "on"))


@query(
    f"""WITH {SQL_CATALOG}, u(unit_id, name, place) AS (VALUES {', '.join(f"({u}, '{n}', {k})" for k, (u, n) in enumerate(UNITS))}),
e AS (SELECT c.doc_id, c.title, u.unit_id FROM catalog c LEFT JOIN u ON trim(c.source) = u.name),
t AS (SELECT e.doc_id, arg_max(u.unit_id, length(u.name) * 1000 - u.place) AS unit_id FROM e JOIN u ON contains(e.title, u.name) WHERE e.unit_id IS NULL GROUP BY 1)
SELECT e.doc_id, coalesce(e.unit_id, t.unit_id) AS unit_id, CASE WHEN e.unit_id IS NOT NULL THEN 'publisher' WHEN t.unit_id IS NOT NULL THEN 'title' ELSE 'none' END AS via FROM e LEFT JOIN t USING (doc_id)"""
)
def j14_attribute_units(spark, sf):
    units = spark.createDataFrame([(u, n, k) for k, (u, n) in enumerate(UNITS)], "unit_id int, name string, place int")
    return reports.attribute_units(views.catalog(spark, sf).withColumnRenamed("source", "publisher"), units)


@query(
    f"""WITH {SQL_CATALOG} SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source IN ('src1', 'src2') THEN 'p' || source WHEN document_kind = 'annual_notice' THEN 'recent_2_school_years' ELSE 'all_history' END AS time_policy FROM catalog"""
)
def j20_time_policies(spark, sf):
    c = views.catalog(spark, sf).drop("time_policy").withColumnRenamed("source", "publisher").withColumn("section", (_id() % 3).cast("string"))
    policies = c.where("publisher in ('src1', 'src2') and section = '0'").select("publisher", "section").distinct().withColumn("time_policy", F.concat(F.lit("p"), "publisher"))
    return reports.with_policy(c, policies, F.when(F.col("document_kind") == "annual_notice", "recent_2_school_years").otherwise("all_history")).select("doc_id", "time_policy")


@query("SELECT doc_id AS answer_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN doc_id ELSE (SELECT min(d.doc_id) FROM documents d WHERE d.doc_id = o.doc_id) END AS source_doc_id FROM documents o")
def j21_primary_sources(spark, sf):
    d = table(spark, sf, "documents")
    none = F.array().cast("array<long>")
    ids = F.when(_id() % 4 == 0, none).when(_id() % 4 == 1, F.array(-_id() - 1, _id(), _id() * 0)).otherwise(F.array(-_id() - 5, -_id() - 1, _id()))
    return reports.primary_sources(d.select(_id().alias("answer_id"), ids.alias("source_doc_ids")), d)


@query("SELECT d.doc_id AS question_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 2 = 0 THEN 'answered' ELSE 'refused' END AS status FROM documents d")
def j17_merge_answers(spark, sf):
    """J-17, J-22: questions without an answer are missing."""
    d = table(spark, sf, "documents")
    answers = d.where("doc_id % 3 != 0").select(_id().alias("question_id"), F.when(_id() % 2 == 0, "answered").otherwise("refused").alias("status"))
    return reports.merge_answers(d.select(_id().alias("question_id")), answers)


SQL_VERSIONS = """r AS (SELECT doc_id AS newer, doc_id - 10 AS older FROM documents WHERE doc_id % 20 = 10), up AS (SELECT older AS doc_id, list(newer) AS up FROM r GROUP BY 1), down AS (SELECT newer AS doc_id, list(older) AS down FROM r GROUP BY 1),
x AS (SELECT doc_id, list_sort(list_distinct(list_concat(CASE WHEN doc_id % 30 = 0 THEN [doc_id - 10, doc_id - 20] ELSE [] END, coalesce(down, [])))) AS s, list_sort(list_distinct(coalesce(up, []))) AS u FROM documents LEFT JOIN up USING (doc_id) LEFT JOIN down USING (doc_id))"""


@query(f"WITH {SQL_VERSIONS} SELECT doc_id, array_to_string(s, ',') AS supersedes, array_to_string(u, ',') AS superseded_by, CASE WHEN len(u) > 0 THEN 'superseded' WHEN len(s) > 0 THEN 'current' ELSE 'unknown_validity' END AS validity_status FROM x")
def j06_apply_versions(spark, sf):
    """J-06, O-08."""
    d = table(spark, sf, "documents")
    none = F.array().cast("array<long>")
    docs = d.select("doc_id", F.when(_id() % 30 == 0, F.array(_id() - 10, _id() - 20)).otherwise(none).alias("supersedes"), F.lit(None).cast("array<long>").alias("superseded_by"), F.lit("unknown_validity").alias("validity_status"))
    out = reports.apply_versions(docs, d.where("doc_id % 20 = 10").select(_id().alias("newer"), (_id() - 10).alias("older")))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("doc_id", join("supersedes"), join("superseded_by"), "validity_status")


@query("SELECT doc_id, '' AS supersedes, 'unknown_validity' AS validity_status, CAST(doc_id % 2 = 0 AS INT) AS relations FROM documents")
def y05_reset_versions(spark, sf):
    d = table(spark, sf, "documents")
    docs = d.select("doc_id", F.array(_id()).alias("supersedes"), F.array(_id()).alias("superseded_by"), F.lit("current").alias("validity_status"))
    docs, kept = reports.reset_versions(docs, d.select(_id().alias("parent"), F.when(_id() % 2 == 0, "attachment_of").otherwise("supersedes").alias("relation")))
    left = docs.join(kept.select(F.col("parent").alias("doc_id"), F.lit(1).alias("relations")), "doc_id", "left")
    return left.select("doc_id", F.array_join(F.col("supersedes").cast("array<string>"), ",").alias("supersedes"), "validity_status", F.coalesce("relations", F.lit(0)).alias("relations"))


@query(f"WITH {SQL_CATALOG} SELECT a.doc_id, coalesce(a.doc_id = b.parent_doc_id, false) OR coalesce(b.doc_id = a.parent_doc_id, false) OR coalesce(a.parent_doc_id = b.parent_doc_id, false) AS family FROM catalog a JOIN catalog b ON b.doc_id = a.doc_id + 1")
def y03_families(spark, sf):
    a = views.catalog(spark, sf).select("doc_id", "parent_doc_id")
    b = a.select(F.col("doc_id").alias("b_id"), F.col("parent_doc_id").alias("b_parent"))
    return a.join(b, F.col("b_id") == _id() + 1).select("doc_id", reports.is_family(_id(), F.col("parent_doc_id"), F.col("b_id"), F.col("b_parent")).alias("family"))


@query(f"WITH {SQL_CATALOG} SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 4 = 0 THEN publish_date || 'x' ELSE publish_date END AS DATE)::VARCHAR AS day FROM catalog")
def y02_dates(spark, sf):
    return views.catalog(spark, sf).select("doc_id", text.iso_date(F.when(_id() % 4 == 0, F.concat("publish_date", F.lit("x"))).otherwise(F.col("publish_date"))).cast("string").alias("day"))


@query(
    """WITH p AS (SELECT doc_id // 40 AS list_id, doc_id % 40 AS page, doc_id * 7 % 5 AS links, doc_id * 11 % 3 AS fresh FROM documents),
w AS (SELECT *, CASE WHEN links = 0 AND lag(links) OVER o = 0 THEN 'empty_pages' WHEN least(links, fresh) = 0 AND lag(least(links, fresh)) OVER o = 0 THEN 'no_new_articles' END AS stop_reason FROM p WINDOW o AS (PARTITION BY list_id ORDER BY page))
SELECT list_id, min(page) AS stop_at, arg_min(stop_reason, page) AS stop_reason FROM w WHERE stop_reason IS NOT NULL GROUP BY list_id"""
)
def w11_stale_runs(spark, sf):
    pages = table(spark, sf, "documents").select(F.floor(_id() / 40).alias("list_id"), (_id() % 40).alias("page"), (_id() * 7 % 5).alias("links"), F.least(_id() * 7 % 5, _id() * 11 % 3).alias("fresh"))
    return reports.stop_of_crawl(pages, "list_id", "page", "links", "fresh")


@query(f"WITH {SQL_CATALOG} SELECT doc_id // 6 AS attachment, arg_max(doc_id, row(publish_date, -doc_id)) AS doc_id FROM catalog GROUP BY 1")
def w13_latest_candidates(spark, sf):
    return reports.latest_candidate(views.catalog(spark, sf).select(F.floor(_id() / 6).alias("attachment"), "doc_id", "publish_date", _id().alias("seq")))


@query(
    """WITH h AS (SELECT doc_id % 40 AS question_id, 'c' || (doc_id % 3) AS collection, doc_id * 7919 % 1009 AS score, doc_id FROM documents)
SELECT question_id, collection, doc_id FROM h QUALIFY collection = 'c0' OR row_number() OVER (PARTITION BY question_id, collection ORDER BY score DESC, doc_id) <= 3"""
)
def t04_secondary_hits(spark, sf):
    hits = table(spark, sf, "documents").select((_id() % 40).alias("question_id"), F.concat(F.lit("c"), (_id() % 3).cast("string")).alias("collection"), (_id() % 3 == 0).alias("is_primary"), (_id() * 7919 % 1009).alias("score"), "doc_id")
    return reports.capped_secondary(hits).select("question_id", "collection", "doc_id")


RETENTION, VALIDITY, QUALITY = ("active", "historical", "archived"), ("current", "superseded", "unknown", "unknown"), ("accepted", None, "quarantined", "accepted", "accepted")


@query(
    f"""WITH {SQL_CATALOG}, s AS (SELECT *, CASE WHEN {_sql(VALIDITY)} = 'superseded' THEN 'historical' ELSE {_sql(RETENTION)} END AS r, coalesce({_sql(QUALITY)}, 'accepted') AS q FROM catalog),
c AS (SELECT doc_id, {COLLECTION.format(r='r')} AS collection FROM s WHERE q = 'accepted' AND text <> '') SELECT doc_id, collection FROM c WHERE collection IS NOT NULL"""
)
def p02_admitted(spark, sf):
    docs = views.catalog(spark, sf).select("doc_id", "document_kind", F.col("text").alias("body"), _pick(RETENTION).alias("retention_status"), _pick(VALIDITY).alias("validity_status"), _pick(QUALITY).alias("quality_status"))
    return reports.admitted(docs, rules.collection_of).select("doc_id", "collection")


@query("SELECT 'c' || (doc_id % 3) AS collection, doc_id // 5 AS doc_id, max(left(sha256(text), 8)) AS signature, count(*) AS chunks FROM documents GROUP BY 1, 2")
def y07_indexed_documents(spark, sf):
    """Y-07, Y-08."""
    chunks = table(spark, sf, "documents").select(F.concat(F.lit("c"), (_id() % 3).cast("string")).alias("collection"), F.floor(_id() / 5).alias("doc_id"), F.left(F.sha2("text", 256), F.lit(8)).alias("signature"))
    return reports.indexed_documents(chunks)


@query(f"SELECT doc_id, {_sql(('main_v2', 'lists_v2', 'old_v2', None))} AS name FROM documents")
def y10_collection_names(spark, sf):
    names = {"main_qa": "main_v2", "public_list": "lists_v2", "historical": "old_v2"}
    return table(spark, sf, "documents").select("doc_id", reports.collection_names(_pick(("main_qa", "public_list", "historical", None)), names).alias("name"))


@query(
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS body, {_sql(QUALITY)} AS q, {_sql(RETENTION)} AS r, {_sql(('main_qa', 'none'))} AS c FROM documents)
SELECT doc_id, body <> '' AS has_body, octet_length(encode(body)) AS body_bytes, coalesce(body <> '' AND q = 'accepted' AND r IN ('active', 'historical') AND c <> 'none', false) AS is_searchable FROM d"""
)
def y25_payloads(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(_id() % 9 == 0, "").otherwise(F.col("text")).alias("body"), _pick(QUALITY).alias("quality_status"), _pick(RETENTION).alias("retention_status"), _pick(("main_qa", "none")).alias("index_collection"))
    return reports.payload(docs).select("doc_id", "has_body", "body_bytes", "is_searchable")


@query("SELECT doc_id, sha256(text) AS content_hash, doc_id + 2000000 AS seq, doc_id % 2 = 0 AS restorable FROM documents WHERE doc_id % 3 = 0")
def y27_document_versions(spark, sf):
    """Y-26, Y-27."""
    d = table(spark, sf, "documents")
    log = d.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2))))).select("doc_id", (_id() + F.col("k") * 1_000_000).alias("seq"), F.sha2("text", 256).alias("content_hash"), F.when(_id() % 2 == 0, F.col("text")).otherwise("changed").alias("body"))
    return reports.version_of(log, d.where("doc_id % 3 = 0").select("doc_id", F.sha2("text", 256).alias("content_hash"))).select("doc_id", "content_hash", "seq", "restorable")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 30")
def y28_recent_actions(spark, sf):
    return reports.recent(table(spark, sf, "events").select("event_id", "event_type"), 30, "event_id")


@query("SELECT doc_id AS url, CASE WHEN doc_id % 6 = 0 THEN 'new' WHEN doc_id % 2 = 0 THEN 'old' WHEN doc_id % 3 = 0 THEN 'new' END AS etag FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def y46_upsert(spark, sf):
    d = table(spark, sf, "documents").select(_id().alias("url"))
    fresh = d.where("url % 3 = 0").withColumn("etag", F.lit("new")).union(d.where("url % 2 = 0 and url % 3 = 1").withColumn("etag", F.lit(None).cast("string")))
    return reports.upsert(d.where("url % 2 = 0").withColumn("etag", F.lit("old")), fresh)


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'If-None-Match: "' || doc_id || '"' END, CASE WHEN doc_id % 3 = 0 THEN 'If-Modified-Since: d' || doc_id END], lambda x: x IS NOT NULL), chr(10)) AS headers FROM documents"""
)
def z02_conditional_headers(spark, sf):
    i = _id().cast("string")
    made = reports.conditional_headers(F.when(_id() % 2 == 0, F.concat(F.lit('"'), i, F.lit('"'))).otherwise(""), F.when(_id() % 3 == 0, F.concat(F.lit("d"), i)))
    return table(spark, sf, "documents").select("doc_id", F.array_join(made, "\n").alias("headers"))


SQL_PLACED = f"{SQL_CATALOG}, h AS (SELECT *, doc_id % 40 AS question_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id * 7919 % 1009, doc_id) AS place FROM catalog QUALIFY place <= 8)"


@query(
    f"""WITH {SQL_PLACED} SELECT question_id, sha256(string_agg('[' || place || '] 《' || title || '》' || CASE WHEN doc_id % 2 = 0 THEN ' 第' || doc_id ELSE '' END || '（' || source || '，发布于 ' || publish_date || '）' || chr(10) || text, chr(10) || chr(10) ORDER BY place)) AS context, count(*) AS n_sources
FROM h GROUP BY question_id"""
)
def r11_contexts(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("question_id").orderBy(_id() * 7919 % 1009, "doc_id"))
    hits = views.catalog(spark, sf).withColumn("question_id", _id() % 40).withColumn("place", place).where("place <= 8").withColumnRenamed("source", "publisher").withColumn("heading", F.when(_id() % 2 == 0, F.concat(F.lit("第"), _id().cast("string"))))
    return reports.context(hits).withColumn("context", F.sha2("context", 256))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 4 > 0 THEN 'offline answer ' || ['', '[1]', '[1][2]', '[1][2][3]'][doc_id % 4 + 1] ELSE 'no evidence' END AS answer FROM documents")
def r12_offline_answers(spark, sf):
    """R-10, R-12."""
    return table(spark, sf, "documents").select("doc_id", reports.offline_answer(_id() % 4, _id() % 3 > 0, "no evidence").alias("answer"))


@query("SELECT doc_id AS question_id FROM documents WHERE doc_id % 3 <> 0")
def z09_resumed(spark, sf):
    """R-13, Y-17, Z-09: what a resumed run still has to answer."""
    d = table(spark, sf, "documents").select(_id().alias("question_id"))
    return reports.resumed(d, d.where("question_id % 3 = 0").withColumn("status", F.lit("answered")), ("answered", "refused"))


@query(f"WITH {SQL_CATALOG} SELECT doc_id FROM catalog WHERE (doc_id % 3 <> 0 OR contains(title, 'tion')) AND (doc_id % 2 <> 0 OR NOT regexp_matches(title, '^Th|er'))")
def p24_listings(spark, sf):
    rows = views.catalog(spark, sf).select("doc_id", "title", F.when(_id() % 3 == 0, "tion").alias("include"), F.when(_id() % 2 == 0, "^Th|er").otherwise("").alias("exclude"))
    return reports.filtered_listing(rows).select("doc_id")


@query(
    """SELECT doc_id, CASE WHEN source = 'src1' AND (contains(text, 'idiot') OR contains(text, '###')) THEN 'safety' WHEN source = 'src1' AND contains(text, 'tion') THEN 'aid' WHEN source = 'src1' THEN 'new' WHEN source = 'src2' THEN 'travel' END AS scene FROM documents"""
)
def p26_scenes(spark, sf):
    """P-26, Y-11: documents without a scene drop out in coverage."""
    special = (("src1", ("idiot", "###"), "safety"), ("src1", ("tion",), "aid"))
    return table(spark, sf, "documents").select("doc_id", reports.scene_of(F.col("source"), F.col("text"), {"src1": "new", "src2": "travel"}, special).alias("scene"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'stale' WHEN doc_id % 6 = 0 THEN 'blocked' WHEN doc_id % 4 = 0 THEN 'published' ELSE 'ready' END AS state FROM documents")
def p32_publish_states(spark, sf):
    """P-32, Y-24."""
    mark = lambda c: F.when(c, "f")
    return table(spark, sf, "documents").select("doc_id", reports.may_publish(F.lit("f"), mark(_id() % 2 == 0), mark(_id() % 4 == 0), F.when(_id() % 3 == 0, 1).otherwise(0)).alias("state"))


@query(f"WITH {SQL_CATALOG} SELECT doc_id, 'event: token' || chr(10) || 'data: {{\"text\": ' || coalesce(CAST(to_json(title) AS VARCHAR), 'null') || '}}' || chr(10) || chr(10) AS event FROM catalog")
def k14_events(spark, sf):
    return views.catalog(spark, sf).select("doc_id", reports.sse(F.lit("token"), F.col("title")).alias("event"))


@query(f"WITH {SQL_CATALOG} SELECT doc_id, title[1:500] AS question, text[1:500] AS answer FROM catalog")
def k15_feedback(spark, sf):
    """K-15, X-19."""
    made = reports.feedback(F.col("title"), F.col("text"))
    return views.catalog(spark, sf).select("doc_id", made.alias("x")).select("doc_id", "x.question", "x.answer")


@query(r"SELECT doc_id, lower(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', '', 'g')) AS norm FROM documents")
def y13_normal_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower(text.squash(F.col("text"))).alias("norm"))


@query(
    """WITH d AS (SELECT doc_id, doc_id // 4 AS g, doc_id % 4 AS k, CASE WHEN g % 4 = 2 THEN '规' ELSE '测试事项管理办法' END || g AS name FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM d),
p AS (SELECT s.doc_id AS source_doc_id, t.doc_id AS target_doc_id, CASE WHEN s.g % 2 = 0 AND length(s.name) >= 6 THEN '修订' || s.name WHEN s.g % 2 = 0 THEN '标题版本标记：（2021年修订）' ELSE '自2022年1月1日起施行' END AS evidence FROM d s JOIN d t ON t.g = s.g AND t.k = s.k + 1 AND s.k = s.g % 2)
SELECT source_doc_id, target_doc_id, 'supersedes' AS relation, 'current' AS status, 0.95::DOUBLE AS confidence, evidence FROM p
UNION ALL SELECT doc_id, NULL, 'version_unknown', 'unknown_validity', 0.0::DOUBLE, '仅发现年份/标题相似，缺少明确施行、修订或废止证据' FROM n WHERE n > 1 AND doc_id NOT IN (SELECT source_doc_id FROM p UNION SELECT target_doc_id FROM p)"""
)
def j05_version_relations(spark, sf):
    """J-05, X-09: four editions of a name, the newest with a mark or the second with words of validity; short names prove nothing by their mention."""
    g, k = F.floor(_id() / 4), _id() % 4
    title = F.concat(F.when(g % 4 == 2, "规").otherwise("测试事项管理办法"), g.cast("string"), F.when((g % 2 == 0) & (k == 0), "（2021年修订）").otherwise(""))
    body = F.concat(F.col("text"), F.when((g % 2 == 1) & (k == 1), "\n本办法自2022年1月1日起施行。").otherwise(""))
    date = F.format_string("%d-01-01", 2023 - k)
    none = F.lit(None).cast("long").alias("parent_doc_id")
    return versions.version_relations(table(spark, sf, "documents").select("doc_id", title.alias("title"), body.alias("body"), date.alias("publish_date"), F.lit("").alias("policy_name"), none))

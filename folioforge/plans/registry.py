"""All queries of the library, with the SQL that checks them. Names begin with the handle of the operator they apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import cascades, rules, text
from folioforge.operators import catalog, chunking, evaluation, links, retrieval, versions
from folioforge.plans import views
from folioforge.plans.views import SQL_ANSWERS, SQL_CATALOG, SQL_LOG, SQL_QUESTIONS, table
from folioforge.sources import tables
from folioforge.storage import shared_dir
from folioforge.streaming import state

FLAGSHIP = "r08_hybrid_search"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# sources and sinks


@query(f"WITH {SQL_CATALOG}, {SQL_LOG} SELECT doc_id, seq, title, document_kind, quality_status FROM log QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1")
def s01_load_manifest(spark, sf):
    """K-01 and S-01: the log is appended as JSON lines, read back and folded."""
    import uuid

    rows, path = views.log(spark, sf), f"{shared_dir(spark)}/folioforge/{spark.sparkContext.applicationId}/log-{uuid.uuid4().hex}"
    tables.append_lines(rows, path)
    return catalog.fold(tables.read_lines(spark, path, rows.schema)).drop("first_seq")


@query(f"WITH {SQL_CATALOG}, r AS (SELECT DISTINCT parent_doc_id AS parent, doc_id AS child FROM catalog WHERE parent_doc_id IS NOT NULL) SELECT parent, child FROM r WHERE child % 2 = 1")
def k02_append_relations(spark, sf):
    """K-02, O-02: relations that are not stored yet."""
    every = views.catalog(spark, sf).where("parent_doc_id is not null").select(F.col("parent_doc_id").alias("parent"), F.col("doc_id").alias("child"))
    return catalog.append_new(every.where("child % 2 = 0"), every.union(every))


# catalog windows


@query(f"WITH {SQL_CATALOG}, {SQL_LOG} SELECT doc_id, max(seq) AS seq, min(seq) AS first_seq, arg_max(title, seq) AS title FROM log GROUP BY doc_id")
def w01_last_wins(spark, sf):
    return catalog.fold(views.log(spark, sf)).select("doc_id", "seq", "first_seq", "title")


@query(f"WITH {SQL_CATALOG}, {SQL_LOG} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS version, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1 AS is_current FROM log QUALIFY version <= 2")
def w10_version_history(spark, sf):
    return catalog.history(views.log(spark, sf), keep=2).select("doc_id", "seq", "version", "is_current")


@query(f"WITH {SQL_CATALOG}, {SQL_LOG} SELECT doc_id, seq, last_value(CASE WHEN quality_status = 'accepted' THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM log")
def w09_previous_accepted(spark, sf):
    return catalog.previous_where(views.log(spark, sf), F.col("quality_status") == "accepted", "title").select("doc_id", "seq", "previous")


@query("SELECT doc_id, text_hash, first_doc FROM (SELECT doc_id, 'sha256:' || left(sha256(text), 16) AS text_hash FROM documents) JOIN (SELECT 'sha256:' || left(sha256(text), 16) AS text_hash, min(doc_id) AS first_doc FROM documents GROUP BY 1) USING (text_hash) WHERE doc_id <> first_doc")
def w12_later_copies(spark, sf):
    """W-12, J-19: documents whose hash an earlier one has; equal texts may fill a third of the table, so minima come first."""
    docs = table(spark, sf, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))
    return docs.join(docs.groupBy("text_hash").agg(F.min("doc_id").alias("first_doc")), "text_hash").where("doc_id != first_doc").select("doc_id", "text_hash", "first_doc")


SQL_LIFE = """sy AS (SELECT *, CASE WHEN publish_date = 'unknown' THEN NULL ELSE try_cast(publish_date AS DATE) END AS day FROM catalog),
age AS (SELECT *, 2025 - (year(day) - CASE WHEN month(day) < 9 THEN 1 ELSE 0 END) AS age FROM sy),
life AS (SELECT doc_id, title, source, document_kind, day,
  CASE WHEN document_kind IN ('policy','procedure','faq','form','manual','service_guide') THEN 'enduring' WHEN document_kind = 'annual_notice' THEN 'annual' WHEN document_kind = 'public_list' THEN 'recurring_public' WHEN document_kind IN ('news','event','promotion') THEN 'ephemeral' ELSE 'undated' END AS temporal_class,
  CASE WHEN document_kind IN ('news','event','promotion','incomplete') THEN 'isolated_document_kind' WHEN time_policy = 'archive_only' THEN 'archive_only' WHEN time_policy = 'all_history' THEN 'all_history'
    WHEN document_kind IN ('policy','procedure','faq','form','manual','service_guide') THEN 'enduring_document' WHEN day IS NULL THEN 'missing_publish_date_for_time_policy' WHEN age < 0 THEN 'future_publish_date'
    WHEN age > CASE time_policy WHEN 'recent_5_school_years' THEN 4 WHEN 'recent_2_school_years' THEN 1 ELSE 0 END THEN 'outside_' || time_policy ELSE time_policy END AS reason FROM age),
lifecycle AS (SELECT *, CASE WHEN reason IN ('all_history', 'enduring_document', 'recent_5_school_years', 'recent_2_school_years', 'current_school_year') THEN 'active' ELSE 'archived' END AS retention FROM life)"""


def _lifecycle(spark, sf):
    return catalog.retention(views.catalog(spark, sf), "2026-03-01")


@query(f"WITH {SQL_CATALOG}, {SQL_LIFE} SELECT doc_id, temporal_class, retention, reason FROM lifecycle")
def x44_retention(spark, sf):
    """X-43 to X-45."""
    return _lifecycle(spark, sf).select("doc_id", "temporal_class", "retention", "reason")


@query(
    f"""WITH {SQL_CATALOG}, {SQL_LIFE}, top AS (SELECT source, arg_max(doc_id, (day IS NOT NULL, coalesce(day, DATE '0001-01-01'), doc_id)) AS best FROM lifecycle WHERE temporal_class = 'annual' AND retention = 'active' GROUP BY source)
SELECT doc_id, CASE WHEN live AND best <> doc_id THEN 'historical' ELSE retention END AS retention, CASE WHEN live AND best <> doc_id THEN 'prior_annual_series_version' ELSE reason END AS reason, CASE WHEN live THEN best END AS canonical_doc_id
FROM (SELECT *, temporal_class = 'annual' AND retention = 'active' AS live FROM lifecycle) LEFT JOIN top USING (source)"""
)
def w02_canonical_annual(spark, sf):
    return catalog.canonical_annual(_lifecycle(spark, sf).withColumn("series_key", F.col("source"))).select("doc_id", "retention", "reason", "canonical_doc_id")


@query(f"WITH {SQL_CATALOG} SELECT c.doc_id, c.parent_doc_id, coalesce(p.title, '') AS parent_title FROM catalog c LEFT JOIN catalog p ON c.parent_doc_id = p.doc_id")
def j01_parent_titles(spark, sf):
    return catalog.with_parent(views.catalog(spark, sf)).select("doc_id", "parent_doc_id", "parent_title")


@query(f"WITH {SQL_CATALOG} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'deleted' WHEN doc_id % 10 = 2 THEN 'updated' WHEN doc_id % 10 = 3 THEN 'metadata_only' ELSE 'unchanged' END AS change FROM catalog")
def j03_index_changes(spark, sf):
    """J-03, O-05 and X-24: signatures of the stored index against those of the catalog."""
    c = views.catalog(spark, sf).select("doc_id", F.sha2("text", 256).alias("e"), F.sha2(F.concat_ws("|", "title", "publish_date"), 256).alias("m"))
    i = F.col("doc_id") % 10
    return catalog.index_changes(c.where(i != 0).select("doc_id", F.when(i == 2, "old").otherwise(F.col("e")), F.when(i == 3, "old").otherwise(F.col("m"))), c.where(i != 1))


@query(f"WITH {SQL_CATALOG} SELECT doc_id FROM catalog c WHERE text LIKE '%###%' AND NOT EXISTS (SELECT 1 FROM catalog a WHERE a.parent_doc_id = c.doc_id)")
def j16_missing_attachment(spark, sf):
    """J-04, J-16: documents that mention an attachment and have no child."""
    c = views.catalog(spark, sf)
    return c.where(F.contains("text", F.lit("###"))).join(c.select(F.col("parent_doc_id").alias("p")).where("p is not null"), F.col("doc_id") == F.col("p"), "left_anti").select("doc_id")


@query(
    f"""WITH {SQL_CATALOG}, d AS (SELECT source AS group_key, publish_date AS day, max(doc_id) AS doc_id FROM catalog WHERE publish_date <> 'unknown' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY day DESC) AS r, lead(doc_id) OVER (PARTITION BY group_key ORDER BY day DESC) AS older FROM d)
SELECT group_key, doc_id AS newer, older FROM r WHERE r % 2 = 1 AND older IS NOT NULL"""
)
def j05_superseding(spark, sf):
    return versions.superseding(views.catalog(spark, sf).withColumn("group_key", F.col("source")))


# text functions and rules


@query(r"SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', '', 'g')) AS squashed, left(sha256(text), 16) AS digest, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n_terms FROM documents")
def x01_text_measures(spark, sf):
    """X-01, X-21, R-03."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(text.squash(t)).alias("squashed"), F.substring(text.text_hash(t), 8, 16).alias("digest"), F.size(text.terms(t)).alias("n_terms"))


@query(
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['s', 'h', 'p', 'q']) AS m FROM pages),
k AS (SELECT page_id, lower(m.h) AS host, lower(m.s) || '://' || lower(m.h) || regexp_replace(m.p, '/+$', '') || coalesce(m.q, '') AS url_key FROM u)
SELECT page_id, host, url_key, left(sha256(url_key), 12) AS doc_key FROM k"""
)
def x30_url_keys(spark, sf):
    """X-22, X-30, X-36."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.host(u).alias("host"), text.url_key(u).alias("url_key"), text.document_key(u).alias("doc_key"))


@query(f"WITH {SQL_CATALOG} SELECT doc_id, CASE WHEN document_kind NOT IN ('annual_notice','public_list','news','event','promotion') THEN 1.0::DOUBLE WHEN publish_date = 'unknown' THEN 0.7::DOUBLE ELSE greatest(0.4::DOUBLE, pow(0.85::DOUBLE, greatest(0, 2025 - CAST(left(publish_date, 4) AS INT)))) END AS weight, CASE WHEN document_kind IN ('policy','procedure') THEN 1.1::DOUBLE WHEN document_kind IN ('news','event') THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM catalog")
def r07_time_weight(spark, sf):
    """R-06, R-07, P-15."""
    return views.catalog(spark, sf).select("doc_id", _time_weight().alias("weight"), rules.boost(F.col("document_kind")).alias("boost"))


def _time_weight():
    return F.when(F.col("document_kind").isin(*rules.TIME_BOUND_KINDS), text.recency_weight(F.col("publish_date"), 2025)).otherwise(1.0)


@query(f"WITH {SQL_CATALOG}, {SQL_LIFE} SELECT doc_id, CASE WHEN retention <> 'active' THEN NULL WHEN document_kind IN ('policy','procedure','faq','annual_notice','form','manual','service_guide') THEN 'main_qa' WHEN document_kind = 'public_list' THEN 'public_list' END AS collection FROM lifecycle")
def p01_collections(spark, sf):
    return _lifecycle(spark, sf).select("doc_id", rules.collection_of(F.col("document_kind"), F.col("retention")).alias("collection"))


_SQL_SQUASHED = r"length(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', '', 'g'))"


@query(
    f"""WITH {SQL_CATALOG}, l AS (SELECT *, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85]'), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS lines, regexp_replace(title, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS t, {_SQL_SQUASHED} AS n FROM catalog),
q AS (SELECT *, len(list_filter(lines, lambda x: length(x) <= 15 AND NOT regexp_matches(x, '[。，；：、！？.,;:!?()（）《》【】\\[\\]{{}}．]'))) AS short,
  CASE WHEN contains(text, '###') THEN 1 ELSE 0 END + CASE WHEN contains(text, '$$$') THEN 1 ELSE 0 END + CASE WHEN contains(text, '%%%') THEN 1 ELSE 0 END + CASE WHEN contains(text, '&&&') THEN 1 ELSE 0 END AS footers,
  regexp_matches(t, '^[0-9a-f]{{8,}}$') AS hashy, lower(t) IN ('eron.', 'erinst resh.') AS generic FROM l),
r AS (SELECT doc_id, list_filter([CASE WHEN n < 120 AND contains(text, 'the') AND NOT has_attachment THEN 'needs_attachment' END, CASE WHEN t = '' THEN 'empty_title' END, CASE WHEN t <> '' AND hashy THEN 'hash_title' END,
  CASE WHEN t <> '' AND NOT hashy AND generic THEN 'generic_title' END, CASE WHEN len(lines) >= 10 AND document_kind <> 'service_guide' AND short / len(lines) > 0.6 THEN 'navigation' END, CASE WHEN footers >= 3 THEN 'footer' END,
  CASE WHEN n < 80 AND NOT has_attachment AND NOT (length(t) >= 12 AND NOT hashy AND NOT generic AND publish_date <> 'unknown') THEN 'short_body' END], lambda x: x IS NOT NULL) AS reasons FROM q)
SELECT doc_id, array_to_string(reasons, ',') AS reasons, CASE WHEN list_contains(reasons, 'needs_attachment') THEN 'incomplete_document' WHEN len(reasons) > 0 THEN 'low_quality' ELSE 'accepted' END AS status, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * len(reasons)) AS score FROM r"""
)
def p07_assess(spark, sf):
    r = rules.quality_reasons(F.col("title"), F.col("text"), F.col("has_attachment"), F.col("publish_date"), F.col("document_kind"), rules.DEMO_QUALITY)
    c = views.catalog(spark, sf).select("doc_id", r.alias("r"))
    return c.select("doc_id", F.array_join("r", ",").alias("reasons"), rules.quality_status(F.col("r")).alias("status"), rules.quality_score(F.col("r")).alias("score"))


@query(
    f"""WITH {SQL_CATALOG}, c AS (SELECT doc_id, title || chr(10) || text AS x, len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda l: regexp_replace(l, '[\\s\\p{{Z}}]', '', 'g') <> '')) AS n FROM catalog)
SELECT doc_id, CASE WHEN contains(x, 'keit') OR contains(x, 'pathetic') THEN 'policy' WHEN contains(x, 'ción') THEN 'procedure' WHEN (contains(x, ' | ') OR contains(x, '!!')) AND n >= 3 THEN 'public_list' WHEN contains(x, 'eau') THEN 'announcement' WHEN contains(x, '###') THEN 'event' WHEN contains(x, 'tion') THEN 'news' ELSE 'unknown' END AS doc_type FROM c"""
)
def p14_document_types(spark, sf):
    return views.catalog(spark, sf).select("doc_id", rules.document_type(F.col("title"), F.col("text"), rules.DEMO_TYPES).alias("doc_type"))


@query(
    r"""WITH a AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(\d+)', ' \1 ', 'g'), ' (\d{16}) ', 1) AS long_, regexp_extract_all(text, '[\d.]+') AS dotted FROM documents)
SELECT doc_id, len(long_) AS n_numbers, len(list_filter(dotted, lambda x: regexp_full_match(x, '\d{1,3}(\.\d{1,3}){3}'))) AS n_addresses FROM a WHERE len(long_) + len(list_filter(dotted, lambda x: regexp_full_match(x, '\d{1,3}(\.\d{1,3}){3}'))) > 0"""
)
def p10_sensitive(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.size(rules.sensitive(F.col("text"), (rules.LONG_NUMBER,))).alias("n_numbers"), F.size(rules.sensitive(F.col("text"), (rules.ADDRESS,))).alias("n_addresses"))
    return d.where("n_numbers + n_addresses > 0")


@query(
    f"""WITH {SQL_ANSWERS}, r AS (SELECT answer_id, n_refs, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '\\[\\s*(\\d+)\\s*\\]', 1), lambda d: NOT (length(d) = 4 AND d BETWEEN '1900' AND '2099')), lambda d: CAST(d AS BIGINT)))) AS refs FROM answers)
SELECT answer_id, len(refs) AS n_citations, len(list_filter(refs, lambda x: x < 1 OR x > n_refs)) AS n_invalid, len(refs) > 0 AND len(list_filter(refs, lambda x: x < 1 OR x > n_refs)) = 0 AS ok FROM r"""
)
def p27_citations(spark, sf):
    """P-27, X-17."""
    t, n = F.col("text"), F.col("n_refs")
    return views.answers(spark, sf).select("answer_id", F.size(text.citation_refs(t)).alias("n_citations"), F.size(text.invalid_refs(t, n)).alias("n_invalid"), text.citations_ok(t, n).alias("ok"))


@query(
    f"""WITH {SQL_ANSWERS}, p AS (SELECT answer_id, n_refs, regexp_extract_all(text, '[^。！？!?；;\\n]*[。！？!?；;\\n]|[^。！？!?；;\\n]+') AS parts FROM answers),
s AS (SELECT answer_id, n_refs, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos FROM p),
b AS (SELECT *, len(list_filter(regexp_extract_all(sentence, '\\[\\s*(\\d+)\\s*\\]', 1), lambda d: NOT (length(d) = 4 AND d BETWEEN '1900' AND '2099') AND (CAST(d AS BIGINT) < 1 OR CAST(d AS BIGINT) > n_refs))) > 0 AS bad FROM s)
SELECT answer_id, pos, sentence FROM b QUALIFY NOT max(bad) OVER (PARTITION BY answer_id ORDER BY pos)"""
)
def u12_gated_stream(spark, sf):
    """U-12, Z-05."""
    return evaluation.gated_stream(views.answers(spark, sf), text.citation_refs(F.col("sentence")))


# chunks and retrieval


@query(
    """WITH n AS (SELECT doc_id, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 480 THEN 1 ELSE CAST(ceil((length(t) - 50) / 430.0) AS BIGINT) END)) AS chunk_index FROM n)
SELECT doc_id, doc_id || ':' || chunk_index AS chunk_id, chunk_index, '' AS heading, substr(t, chunk_index * 430 + 1, 480) AS text FROM p"""
)
def u01_chunks(spark, sf):
    """U-01 to U-03."""
    return chunking.split_documents(table(spark, sf, "documents"))


SQL_BM25 = r"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok), tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM post GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, n), idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id AS question_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark), qf AS (SELECT question_id, term, count(*) AS qf FROM q GROUP BY ALL),
bm AS (SELECT question_id, doc_id, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM tf JOIN qf USING (term) JOIN idf USING (term), n GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20)"""


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")


@query(f"WITH {SQL_BM25} SELECT question_id, doc_id, score, rank FROM lex")
def r04_bm25(spark, sf):
    """R-04, T-02."""
    return retrieval.bm25(table(spark, sf, "documents"), _asked(spark, sf))


@query(
    r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents), n AS (SELECT count(*) AS n FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM tok) GROUP BY term), raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, n)
SELECT term, round(CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean ELSE idf END, 6) AS idf FROM raw CROSS JOIN (SELECT avg(idf) AS mean FROM raw)"""
)
def a19_inverse_frequencies(spark, sf):
    return retrieval.inverse_frequencies(retrieval.vocabulary(table(spark, sf, "documents"))).withColumn("idf", F.round("idf", 6))


SQL_VECTOR = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
{asked}, sims AS (SELECT a.question_id, m.vec_id AS doc_id, round(list_dot_product(a.e, m.e) / (a.n * m.n), 9) AS score FROM a, m WHERE a.n > 0 AND m.n > 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM sims QUALIFY rank <= 20)"""


@query("WITH " + SQL_VECTOR.format(asked="a AS (SELECT vec_id AS question_id, e, n FROM m WHERE vec_id % 50 = 0)") + " SELECT question_id, doc_id, score, rank FROM dense")
def t01_vector_search(spark, sf):
    """T-01: every vector whose id is divisible by 50 asks all vectors."""
    e = table(spark, sf, "embeddings")
    return retrieval.vector_search(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")))


SQL_WEIGHT = "CASE WHEN document_kind NOT IN ('annual_notice','public_list','news','event','promotion') THEN 1.0::DOUBLE WHEN publish_date = 'unknown' THEN 0.7::DOUBLE ELSE greatest(0.4::DOUBLE, pow(0.85::DOUBLE, greatest(0, 2025 - CAST(left(publish_date, 4) AS INT)))) END"
SQL_HYBRID = (
    f"WITH {SQL_CATALOG}, {SQL_BM25}, "
    + SQL_VECTOR.format(asked="a AS (SELECT item_id AS question_id, e, n FROM m JOIN benchmark ON item_id = vec_id)")
    + f""", fused AS (SELECT question_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT question_id, doc_id, rank FROM lex UNION ALL SELECT question_id, doc_id, rank FROM dense) GROUP BY ALL),
wide AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) <= 24),
w AS (SELECT question_id, doc_id, round(wide.score * coalesce({SQL_WEIGHT}, 1.0::DOUBLE), 12) AS score FROM wide LEFT JOIN catalog USING (doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM w),
final AS (SELECT best.question_id, best.doc_id, best.score, dense.score AS similarity, best.rank FROM best LEFT JOIN dense USING (question_id, doc_id) WHERE best.rank <= 8)"""
)


@query(f"{SQL_HYBRID} SELECT question_id, doc_id, score, similarity, rank FROM final")
def r08_hybrid_search(spark, sf):
    """R-04 to R-08, T-01 to T-03, W-04: the flagship. A question's vector is that of the same id."""
    lexical = retrieval.bm25(table(spark, sf, "documents"), _asked(spark, sf))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = e.join(F.broadcast(_asked(spark, sf).select("question_id")), F.col("doc_id") == F.col("question_id")).select("question_id", "vector")
    weights = views.catalog(spark, sf).select("doc_id", _time_weight().alias("weight"))
    return retrieval.hybrid(lexical, retrieval.vector_search(e, asked), weights).select("question_id", "doc_id", "score", "similarity", "rank")


@query(f"{SQL_HYBRID} SELECT question_id, coalesce(bool_or(similarity >= 0.5), false) AS confident FROM final GROUP BY question_id")
def p06_confident(spark, sf):
    return retrieval.confident(r08_hybrid_search(spark, sf))




# evaluation


SQL_HITS = f"""{SQL_CATALOG}, {SQL_QUESTIONS}, met AS (SELECT q.question_id, c.doc_id, c.publish_date, len(list_filter(q.terms, lambda t: contains(c.text, t))) AS n_terms FROM questions q JOIN catalog c ON list_contains(q.domains, c.source)),
hits AS (SELECT question_id, doc_id, n_terms, n_terms + 2 AS score, row_number() OVER (PARTITION BY question_id ORDER BY n_terms DESC, publish_date DESC, doc_id) AS rank FROM met WHERE n_terms >= 2 QUALIFY rank <= 5)"""


def _hits(spark, sf):
    docs = views.catalog(spark, sf).select("doc_id", F.col("source").alias("domain"), "text", "publish_date")
    return evaluation.coverage_hits(views.questions(spark, sf), docs)


@query(f"WITH {SQL_HITS} SELECT question_id, doc_id, n_terms, score, rank FROM hits")
def j07_coverage_hits(spark, sf):
    """J-07, T-05."""
    return _hits(spark, sf).select("question_id", "doc_id", "n_terms", "score", "rank")


@query(
    f"""WITH {SQL_HITS}, p AS (SELECT question_id, unnest(terms) AS point FROM questions), e AS (SELECT p.question_id, p.point, h.doc_id, c.text FROM p JOIN hits h USING (question_id) JOIN catalog c USING (doc_id) WHERE contains(c.text, p.point) QUALIFY row_number() OVER (PARTITION BY p.question_id, p.point ORDER BY h.rank) = 1)
SELECT question_id, point, doc_id, substr(text, greatest(1, strpos(text, point) - 50), strpos(text, point) + 110 - greatest(1, strpos(text, point) - 50)) AS excerpt FROM e"""
)
def j08_point_evidence(spark, sf):
    """J-08, X-13."""
    points = views.questions(spark, sf).select("question_id", F.explode("terms").alias("point"))
    return evaluation.point_evidence(_hits(spark, sf), points, views.catalog(spark, sf))


SQL_STATUS = f"{SQL_HITS}, st AS (SELECT question_id, scene, coalesce(n, 0) AS n_hits, CASE WHEN best >= 5 THEN 'answerable' WHEN best IS NOT NULL THEN 'partial' ELSE 'not_answerable' END AS status FROM questions LEFT JOIN (SELECT question_id, max(n_terms) AS best, count(*) AS n FROM hits GROUP BY 1) USING (question_id))"


@query(f"WITH {SQL_STATUS} SELECT scene, count(*) AS total, count_if(status = 'answerable') AS answerable, count_if(status = 'partial') AS partial, count_if(status = 'not_answerable') AS not_answerable, round(count_if(status = 'answerable') / count(*), 6) AS rate FROM st GROUP BY scene")
def a03_scene_statistics(spark, sf):
    """J-09, A-03, A-05, A-11."""
    return evaluation.scene_statistics(evaluation.question_status(views.questions(spark, sf), _hits(spark, sf)))


GATES = {"no_duplicates": ("rate", "<=", 0.1), "enough_documents": ("n_docs", ">=", 500), "no_unanswered": ("unanswered", "==", 0)}


@query(
    f"""WITH {SQL_STATUS}, d AS (SELECT count(*) AS n FROM documents GROUP BY sha256(text)), f AS (SELECT sum(n - 1) / sum(n) AS rate, sum(n)::DOUBLE AS n_docs, (SELECT count_if(status = 'not_answerable') FROM st)::DOUBLE AS unanswered FROM d),
g AS (SELECT 'no_duplicates' AS gate, rate AS value, rate <= 0.1 AS passed FROM f UNION ALL SELECT 'enough_documents', n_docs, n_docs >= 500 FROM f UNION ALL SELECT 'no_unanswered', unanswered, unanswered = 0 FROM f)
SELECT * FROM g UNION ALL SELECT 'all', NULL, bool_and(passed) FROM g"""
)
def a08_gates(spark, sf):
    """A-02, A-07, A-08: facts are one-row aggregates; crossing them is free."""
    facts = catalog.duplicate_rate(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h")
    unanswered = evaluation.question_status(views.questions(spark, sf), _hits(spark, sf)).agg(F.count_if(F.col("status") == "not_answerable").alias("unanswered"))
    return evaluation.gates(facts.crossJoin(F.broadcast(unanswered)), GATES)


@query("SELECT 'sha256:' || left(sha256(text), 16) AS text_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def a02_duplicate_groups(spark, sf):
    return catalog.duplicate_groups(table(spark, sf, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash")), "text_hash")


@query(f"WITH {SQL_CATALOG}, {SQL_LIFE} SELECT temporal_class, count(*) AS total, count_if(retention = 'active') AS active, count_if(retention = 'archived') AS archived, count(DISTINCT source) AS sources FROM lifecycle GROUP BY 1")
def a09_audit(spark, sf):
    """A-01, A-09, A-16."""
    return _lifecycle(spark, sf).groupBy("temporal_class").agg(F.count("*").alias("total"), F.count_if(F.col("retention") == "active").alias("active"), F.count_if(F.col("retention") == "archived").alias("archived"), F.countDistinct("source").alias("sources"))


@query(f"WITH {SQL_CATALOG} SELECT avg(CASE WHEN quality = 1 THEN (n > 500)::INT END) AS hit_rate, avg(CASE WHEN quality = 0 THEN (n <= 500)::INT END) AS refusal_rate FROM (SELECT quality, length(text) AS n FROM labels JOIN catalog USING (doc_id))")
def a13_rates(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select((F.col("quality") == 1).alias("expected"), (F.length("text") > 500).alias("given"))
    return evaluation.rates(rows, "expected", "given")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def a15_timeline(spark, sf):
    return evaluation.timeline(table(spark, sf, "events"), "ts")


@query(f"WITH {SQL_CATALOG} SELECT count(*) AS n, max(publish_date) AS latest, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM catalog")
def a17_meta(spark, sf):
    return views.catalog(spark, sf).agg(F.count("*").alias("n"), F.max("publish_date").alias("latest"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("SELECT sha256(string_agg(item_id || '|' || text, chr(10) ORDER BY item_id)) AS fingerprint FROM benchmark")
def a18_fingerprint(spark, sf):
    return evaluation.fingerprint(table(spark, sf, "benchmark"), F.concat_ws("|", F.col("item_id").cast("string"), "text"), "item_id")


@query(f"WITH {SQL_CATALOG} SELECT doc_id, title, publish_date FROM catalog WHERE document_kind = 'policy' ORDER BY publish_date DESC, doc_id DESC LIMIT 20 OFFSET 10")
def p31_admin_list(spark, sf):
    """P-31, T-09: a page of a sorted list."""
    return views.catalog(spark, sf).where("document_kind = 'policy'").orderBy(F.desc("publish_date"), F.desc("doc_id")).offset(10).limit(20).select("doc_id", "title", "publish_date")


# pages and events


@query(
    r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
x AS (SELECT page_id, unnest(h) AS href, unnest(t) AS raw, generate_subscripts(h, 1) - 1 AS pos FROM a)
SELECT page_id, pos, href, regexp_replace(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS anchor FROM x"""
)
def u05_links(spark, sf):
    """U-05, S-44."""
    return links.page_links(table(spark, sf, "pages"))


@query(r"SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[|｜]'), lambda x: regexp_replace(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> ''), chr(10)) AS segments FROM pages")
def x11_title_segments(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(links.title_segments(F.col("html")), "\n").alias("segments"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT * FROM l QUALIFY pos = 1 OR line <> lag(line) OVER (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM k GROUP BY doc_id"""
)
def w08_drop_repeated_lines(spark, sf):
    return links.drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, true AS allowed, [t] AS held FROM e WHERE n = 1 UNION ALL
  SELECT user_id, event_id, n, len(k) < 2, CASE WHEN len(k) < 2 THEN list_append(k, t) ELSE k END FROM (SELECT e.*, list_filter(f.held, lambda x: e.t - x <= 3600000000) AS k FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT event_id, user_id, allowed FROM f"""
)
def z03_rate_limit(spark, sf):
    """Z-03: a stateful fold; the SQL walks each user's events one by one."""
    return state.rate_limit(table(spark, sf, "events"), limit=2, seconds=3600)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def z08_windowed_counts(spark, sf):
    """An extension: event-time counts."""
    return state.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH s AS (SELECT url, max(page_id) AS page_id FROM pages WHERE page_id % 3 <> 0 GROUP BY url), n AS (SELECT url, max(page_id) AS page_id FROM pages WHERE page_id % 3 <> 1 GROUP BY url) SELECT url, page_id, 'active' AS status FROM n UNION ALL SELECT url, page_id, 'not_seen' FROM s WHERE url NOT IN (SELECT url FROM n)")
def z01_crawl_state(spark, sf):
    """Z-01, O-06."""
    by_url = lambda k: table(spark, sf, "pages").where(f"page_id % 3 != {k}").groupBy("url").agg(F.max("page_id").alias("page_id"))
    return state.merge_state(by_url(0), by_url(1))


# kinds, admission levels, topics, facts and evidence


SQL_MARKED = f"WITH {SQL_CATALOG}, m AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'low_quality' ELSE 'accepted' END AS quality_status, 'https://' || source || '.example.org/d/' || doc_id AS url FROM catalog)"


def _marked(spark, sf):
    """The catalog with a quality status and a URL."""
    status = F.when(F.col("doc_id") % 9 == 0, "low_quality").otherwise("accepted")
    return views.catalog(spark, sf).withColumn("quality_status", status).withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), F.col("doc_id").cast("string")))


@query(
    rf"""{SQL_MARKED} SELECT doc_id, CASE WHEN quality_status = 'low_quality' THEN 'incomplete'
  WHEN regexp_matches(title, '^[A-Z][a-z]+ung ') THEN 'policy' WHEN contains(title, ' | ') THEN 'public_list'
  WHEN (contains(title, 'keit') AND NOT contains(title, 'keit ')) OR contains(title, '###') THEN 'news'
  WHEN contains(title, '$$$') THEN 'promotion' WHEN contains(title, '%%%') THEN 'event'
  WHEN regexp_matches(title, 'schaft|&&&') AND NOT contains(title, 'keit ') THEN 'news'
  WHEN regexp_matches(title, '[0-9]{{4}}') AND regexp_matches(title, '[ea]') THEN 'annual_notice'
  WHEN contains(text, '???') THEN 'faq'
  WHEN regexp_matches(title, 'ción|dad ') OR (contains(text[1:500], '. ') AND regexp_matches(text[1:500], 'ción|dad ')) THEN 'policy'
  WHEN contains(text, 'eau') AND length(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) < 300 THEN 'form'
  WHEN contains(text, '!!') THEN 'manual' WHEN contains(text, '@') THEN 'service_guide' WHEN regexp_matches(text, 'heit|ment ') THEN 'procedure'
  WHEN contains(title, 'tion') THEN 'annual_notice' WHEN has_attachment THEN 'manual' ELSE 'incomplete' END AS kind FROM m"""
)
def p12_document_kind(spark, sf):
    kind = cascades.document_kind(F.col("title"), F.col("text"), F.col("quality_status"), F.col("has_attachment"), cascades.DEMO_KINDS)
    return _marked(spark, sf).select("doc_id", kind.alias("kind"))


SQL_LEVEL = """h AS (SELECT *, text[1:1500] AS head FROM catalog), v AS (SELECT *, regexp_matches(title, 'able') OR regexp_matches(head, 'ous ') AS master FROM h),
lv AS (SELECT *, CASE WHEN NOT regexp_matches(title, '[aeiou]n') THEN ''
  WHEN contains(head, '###') OR (regexp_matches(title, 'keit|ción') AND NOT regexp_matches(head, 'tion[^.]{0,8}e')) THEN 'non_degree_program'
  WHEN contains(title, 'heit') OR (contains(title, 'ment') AND contains(title || head[1:400], 'eau')) THEN 'recommendation_admission'
  WHEN contains(title, 'schaft') THEN 'reexamination' WHEN contains(title, 'ung ') THEN 'adjustment'
  WHEN (contains(title, 'ique') OR contains(head, 'ent ')) AND NOT master THEN 'doctoral_admission' WHEN master THEN 'master_admission'
  WHEN regexp_matches(head, 'ir|el') OR regexp_matches(title, 'ir|el') THEN 'undergraduate_admission' WHEN contains(title, 'e') THEN 'other_admission' ELSE '' END AS level FROM v)"""


def _levels(spark, sf):
    return views.catalog(spark, sf).withColumn("level", cascades.admission_level(F.col("title"), F.col("text"), cascades.DEMO_ADMISSION))


@query(f"WITH {SQL_CATALOG}, {SQL_LEVEL} SELECT doc_id, level FROM lv")
def p13_admission_level(spark, sf):
    return _levels(spark, sf).select("doc_id", "level")


@query(
    f"""WITH {SQL_CATALOG}, {SQL_LEVEL} SELECT doc_id, CASE level WHEN 'recommendation_admission' THEN '推免/预推免' WHEN 'reexamination' THEN '复试/调剂' WHEN 'adjustment' THEN '复试/调剂'
  WHEN 'doctoral_admission' THEN '博士招生' WHEN 'master_admission' THEN '硕士招生' WHEN 'undergraduate_admission' THEN '本科招生' WHEN 'non_degree_program' THEN '非学历项目' WHEN 'other_admission' THEN '其他招生'
  ELSE CASE WHEN contains(title, 'ción') THEN 'one' WHEN regexp_matches(title, 'eau|ique') THEN 'two' WHEN regexp_matches(title, 'tion|ness') THEN 'three'
  WHEN contains(text[1:400], 'ción') THEN 'one' WHEN regexp_matches(text[1:400], 'eau|ique') THEN 'two' WHEN regexp_matches(text[1:400], 'tion|ness') THEN 'three' ELSE '其他' END END AS topic FROM lv"""
)
def p19_topic(spark, sf):
    return _levels(spark, sf).select("doc_id", cascades.topic(F.col("title"), F.col("text"), F.col("level"), cascades.DEMO_TOPICS).alias("topic"))


@query(
    r"""WITH f AS (SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|1[3-9][0-9]{9}|0[0-9]{2,3}-?[0-9]{7,8}|QQ|https?://') AS c,
  regexp_matches(text, '20[0-9]{2}-[0-9]{2}-[0-9]{2}') AS d, regexp_matches(text, '[0-9]{2,}') AS n FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN c THEN 'contact' END, CASE WHEN d THEN 'date' END, CASE WHEN n THEN 'number' END) AS facts, (coalesce(c, false)::INT + coalesce(d, false)::INT + coalesce(n, false)::INT) >= 2 AS enough FROM f"""
)
def p17_fact_signals(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(cascades.fact_signals(F.col("text")), ",").alias("facts"), cascades.has_facts(F.col("text")).alias("enough"))


@query(
    f"""WITH {SQL_CATALOG}, g AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'force_include' WHEN publish_date = 'unknown' THEN 'unknown_date' WHEN publish_date < '2020-06-01' THEN 'too_old' ELSE 'in_window' END AS reason FROM catalog)
SELECT doc_id, reason <> 'too_old' AS open, reason FROM g"""
)
def p21_date_gate(spark, sf):
    return views.catalog(spark, sf).select("doc_id", cascades.date_gate(F.col("publish_date"), F.col("doc_id") % 10 == 0, "2020-06-01").alias("g")).select("doc_id", "g.open", "g.reason")


@query(r"SELECT page_id, coalesce(regexp_matches(url, '(?i)^https?://') AND lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) = 'blog.tionsh.example.net' AND regexp_matches(url, '^[A-Za-z]+://[^/?#]*/e'), false) AS is_article FROM pages")
def p22_article_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", cascades.article_url(F.col("url"), "blog.tionsh.example.net", "/e").alias("is_article"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, string_split(regexp_extract(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '(?s)^(.*?)(?:\n\s*\n|\z)', 1), '.')[1] AS first FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT conv_id, turn, regexp_matches(first, 'en|er') AND regexp_matches(first, 'ti|un') AS refused FROM s"""
)
def p28_evidence_refusal(spark, sf):
    refused = cascades.evidence_refusal(F.col("text"), ("en", "er"), ("ti", "un"), ".")
    return table(spark, sf, "conversations").where("role = 'assistant' and text is not null").select("conv_id", "turn", refused.alias("refused"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '(?m)[ \t]+$', '', 'g')) AS digest FROM documents")
def x18_trim_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(cascades.trim_lines(F.col("text")), 256).alias("digest"))


@query(f"{SQL_MARKED} SELECT c.doc_id, p.source || '.example.org' AS domain FROM m c JOIN m p ON c.parent_doc_id = p.doc_id")
def j02_parent_domains(spark, sf):
    return catalog.parent_domains(_marked(spark, sf))


@query(
    f"""{SQL_MARKED} SELECT source, count(DISTINCT coalesce(CASE WHEN doc_id % 3 = 0 THEN 'topic' || (doc_id % 5) END, CASE WHEN doc_id % 4 = 0 THEN 'policy' || (doc_id % 7) END, title)) AS topics
FROM m WHERE quality_status = 'accepted' AND document_kind IN ('policy', 'procedure', 'annual_notice') GROUP BY source"""
)
def a04_valid_topics(spark, sf):
    named = lambda word, every, of: F.when(F.col("doc_id") % every == 0, F.concat(F.lit(word), (F.col("doc_id") % of).cast("string"))).otherwise("")
    return catalog.valid_topics(_marked(spark, sf).withColumn("topic_key", named("topic", 3, 5)).withColumn("policy_name", named("policy", 4, 7)), "source")


@query(
    f"""WITH {SQL_CATALOG}, p AS (SELECT doc_id, text, ['er', 'a', 'zz', 'tion '][doc_id % 4 + 1] AS point FROM catalog)
SELECT doc_id, contains(text, point) OR CASE WHEN point = 'er' THEN regexp_matches(text, '@|###') WHEN point = 'a' THEN regexp_matches(text, '[0-9]{{3}}') ELSE false END AS supported FROM p"""
)
def p25_point_supported(spark, sf):
    point = F.element_at(F.array(*map(F.lit, ("er", "a", "zz", "tion "))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", cascades.point_supported(F.col("text"), point, cascades.DEMO_POINTS).alias("supported"))


@query(
    f"""WITH {SQL_CATALOG}, a AS (SELECT *, (doc_id % 10) / 10.0::DOUBLE AS sim, document_kind IN ('policy','procedure','faq','form','manual','service_guide') OR (document_kind = 'annual_notice' AND publish_date >= '2022') AND publish_date <> 'unknown' AS fit FROM catalog),
r AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN '无高置信检索结果' WHEN doc_id % 13 = 1 THEN 'probe 状态 partial，待复核' WHEN sim < 0.55 THEN 'top 相似度 ' || printf('%.2f', sim) || ' 低于固化线 0.55'
  WHEN NOT fit THEN '命中文档类型不足以作为依据（' || document_kind || '）' ELSE '' END AS reason FROM a)
SELECT doc_id, CASE WHEN reason = '' THEN 'grounded' ELSE 'needs_docs' END AS status, CASE WHEN reason = '' THEN doc_id::VARCHAR ELSE '' END AS doc_ids, reason FROM r"""
)
def p29_grounding(spark, sf):
    hit = F.struct("doc_id", (F.col("doc_id") % 10 / F.lit(10.0)).alias("similarity"), "document_kind", "publish_date")
    status = F.when(F.col("doc_id") % 13 == 0, "not_answerable").when(F.col("doc_id") % 13 == 1, "partial").otherwise("answerable")
    made = views.catalog(spark, sf).select("doc_id", cascades.grounding(status, F.array(hit, hit), F.array().cast("array<string>"), 2025).alias("g"))
    return made.select("doc_id", "g.status", F.array_join(F.col("g.doc_ids").cast("array<string>"), ",").alias("doc_ids"), "g.reason")


def _retained(spark, sf):
    status = F.element_at(F.array(*map(F.lit, ("active", "historical", "archived"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return views.catalog(spark, sf).withColumn("retention_status", status)


SQL_RETAINED = f"WITH {SQL_CATALOG}, r AS (SELECT *, ['active', 'historical', 'archived'][doc_id % 3 + 1] AS retention_status FROM catalog)"


@query(
    f"""{SQL_RETAINED}, s AS (SELECT source || lang AS k, count(*) AS n, count(*) FILTER (retention_status = 'active') AS a FROM r WHERE document_kind = 'annual_notice' GROUP BY ALL)
SELECT count(*) AS annual_series, count(*) FILTER (n > 1) AS duplicate_series, count(*) FILTER (a > 1) AS duplicate_active_series FROM s"""
)
def a10_series_counts(spark, sf):
    docs = _retained(spark, sf).withColumn("temporal_class", rules.temporal_class(F.col("document_kind"))).withColumn("series_key", F.concat("source", "lang"))
    return evaluation.series_counts(docs)


@query(
    f"""{SQL_RETAINED}, c AS (SELECT doc_id, CASE WHEN document_kind IN ('policy','procedure','annual_notice','form','manual','service_guide') AND retention_status = 'historical' THEN 'historical' WHEN retention_status <> 'active' THEN NULL
  WHEN document_kind IN ('policy','procedure','faq','annual_notice','form','manual','service_guide') THEN 'main_qa' WHEN document_kind = 'public_list' THEN 'public_list' END AS wanted FROM r),
d AS (SELECT doc_id, wanted, CASE WHEN doc_id % 10 = 0 THEN 'main_qa' ELSE wanted END AS collection, unnest(range(0, doc_id % 4 + 1)) AS k FROM c)
SELECT collection, count(*) AS chunk_count, count(DISTINCT doc_id) AS document_count, count(DISTINCT CASE WHEN collection IS DISTINCT FROM wanted THEN doc_id END) AS invalid_documents FROM d WHERE collection IS NOT NULL GROUP BY collection"""
)
def a06_collection_stats(spark, sf):
    wanted = rules.collection_of(F.col("document_kind"), F.col("retention_status"))
    chunks = _retained(spark, sf).withColumn("wanted", wanted).withColumn("collection", F.when(F.col("doc_id") % 10 == 0, "main_qa").otherwise(F.col("wanted")))
    chunks = chunks.where("collection is not null").select("doc_id", "wanted", "collection", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4)).alias("k"))
    return evaluation.collection_stats(chunks, F.col("wanted"))


@query(
    f"""WITH {SQL_CATALOG}, e AS (SELECT doc_id * 7 % 400 AS question_id, doc_id FROM catalog WHERE doc_id % 3 = 0), h AS (SELECT doc_id * 7 % 400 + doc_id % 2 * 7 AS question_id, doc_id, parent_doc_id FROM catalog WHERE doc_id % 5 > 1)
SELECT e.question_id, coalesce(bool_or(h.doc_id IS NOT NULL), false) AS hit FROM e LEFT JOIN h ON e.question_id = h.question_id AND (e.doc_id = h.doc_id OR e.doc_id = h.parent_doc_id) GROUP BY e.question_id"""
)
def j10_family_hits(spark, sf):
    docs, i = views.catalog(spark, sf), F.col("doc_id")
    expected = docs.where("doc_id % 3 = 0").select((i * 7 % 400).alias("question_id"), "doc_id")
    hits = docs.where("doc_id % 5 > 1").select((i * 7 % 400 + i % 2 * 7).alias("question_id"), "doc_id", "parent_doc_id")
    return evaluation.family_hits(hits, expected)


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'left' ELSE 'right' END AS side FROM documents WHERE (doc_id % 3 <> 0) <> (doc_id % 4 <> 0)")
def j18_unmatched_keys(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return catalog.unmatched_keys(docs.where("doc_id % 3 != 0"), docs.where("doc_id % 4 != 0"))


def _sql_kind_of(prefix: str, more: str) -> str:
    """The SQL of p12 over other rows ``m``, as a table ``kinds``, and what selects from it."""
    return f"{prefix}, kinds AS ({_SQL['p12_document_kind'].removeprefix(SQL_MARKED)}) {more}"


SQL_PLAIN = f"WITH {SQL_CATALOG}, a AS (SELECT doc_id, regexp_replace(title, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS title, text, 'accepted' AS quality_status, false AS has_attachment FROM catalog)"


@query(
    _sql_kind_of(
        f"{SQL_PLAIN}, m AS (SELECT * REPLACE (text[1:600] AS text) FROM a), facts AS ({_SQL['p17_fact_signals'].replace('WITH f AS', 'WITH ff AS').replace('FROM f', 'FROM ff')})",
        """, w AS (SELECT m.*, kind, facts, enough, CASE WHEN contains(title, '###') THEN '###' WHEN contains(title, 'keit') THEN 'keit' WHEN contains(title, '$$') THEN '$$' ELSE '' END AS ex,
  CASE WHEN contains(title, 'tion') THEN 'tion' WHEN contains(title, 'eau') THEN 'eau' ELSE '' END AS inc,
  list_filter(['heit', 'ment', 'ung'], lambda x: contains(text, x)) AS news, list_filter(['ción', 'dad', 'ento'], lambda x: contains(text, x)) AS party FROM m JOIN kinds USING (doc_id) JOIN facts USING (doc_id)),
r AS (SELECT *, CASE WHEN ex <> '' AND (ex <> 'keit' OR (inc = '' AND NOT contains(title, 'ung'))) THEN 'strong_exclude'
  WHEN text <> '' AND inc = '' AND (kind IN ('news', 'event', 'promotion') OR len(news) >= 2 OR len(party) >= 2) THEN 'news_noise' WHEN text <> '' AND NOT enough THEN 'no_facts' WHEN inc <> '' THEN 'strong_include' ELSE 'neutral_pass' END AS reason FROM w)
SELECT doc_id, reason IN ('strong_include', 'neutral_pass') AS keep, reason, CASE reason WHEN 'strong_exclude' THEN ex WHEN 'strong_include' THEN inc WHEN 'no_facts' THEN facts WHEN 'neutral_pass' THEN ''
  ELSE CASE WHEN kind IN ('news', 'event', 'promotion') THEN kind WHEN len(news) >= 2 THEN array_to_string(news, '+') ELSE '党建:' || array_to_string(list_sort(party), '+') END END AS matched FROM r""",
    )
)
def p16_relevance(spark, sf):
    made = cascades.relevance(F.col("title"), F.col("text"), cascades.DEMO_RELEVANCE, cascades.DEMO_KINDS)
    return views.catalog(spark, sf).select("doc_id", made.alias("r")).select("doc_id", "r.keep", "r.reason", "r.matched")


@query(_sql_kind_of(f"{SQL_PLAIN}, m AS (SELECT * FROM a)", "SELECT doc_id, CASE WHEN regexp_matches(title, 'ent|un') AND NOT regexp_matches(title, 'ti[a-z]') THEN 'procedure' ELSE kind END AS kind FROM kinds JOIN m USING (doc_id)"))
def p20_account_kind(spark, sf):
    kind = cascades.account_kind(F.col("title"), F.col("text"), "ent|un", "ti[a-z]", cascades.DEMO_KINDS)
    return views.catalog(spark, sf).select("doc_id", kind.alias("kind"))


@query(
    """WITH n AS (SELECT 'src' || k AS name, 'acc' || k AS account_id, k AS position FROM range(12) t(k) WHERE k % 4 <> 3 UNION ALL SELECT 'src' || (k + 6), 'acc' || k, k FROM range(12) t(k) WHERE k % 4 <> 3),
f AS (SELECT name, arg_min(account_id, position) AS account_id FROM n GROUP BY name) SELECT doc_id, account_id FROM documents LEFT JOIN f ON source = name"""
)
def j12_match_accounts(spark, sf):
    k = F.col("id")
    name = lambda x: F.concat(F.lit("src"), x.cast("string"))
    accounts = spark.range(12).select(F.concat(F.lit("acc"), k.cast("string")).alias("account_id"), name(k).alias("account_name"), F.array(name(k + 6)).alias("aliases"), (k % 4 != 3).alias("enabled"), k.alias("position"))
    articles = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(" "), "source").alias("account"))
    return links.match_accounts(articles, accounts).select("doc_id", "account_id")


@query(
    f"""{SQL_RETAINED}, d AS (SELECT *, CASE WHEN doc_id % 5 = 3 THEN 'attachment' ELSE 'article' END AS document_type FROM r),
e AS (SELECT doc_id AS child, doc_id - 1 AS parent FROM d WHERE doc_id % 5 = 3 UNION ALL SELECT doc_id, doc_id - 2 FROM d WHERE doc_id % 5 = 3),
b AS (SELECT child, arg_max({{'id': p.doc_id, 'status': p.retention_status, 'series': p.source}}, row(CASE p.retention_status WHEN 'active' THEN 2 WHEN 'historical' THEN 1 ELSE 0 END, p.publish_date, p.doc_id)) AS p FROM e JOIN d p ON e.parent = p.doc_id GROUP BY child),
m AS (SELECT d.*, p, coalesce(document_type = 'attachment' AND document_kind <> 'incomplete' AND retention_status = 'archived' AND p.status <> 'archived' AND (document_kind IN ('policy','procedure','annual_notice','form','manual','service_guide')
  OR (p.status = 'active' AND document_kind IN ('faq', 'public_list'))), false) AS moves FROM d LEFT JOIN b ON d.doc_id = b.child)
SELECT doc_id, CASE WHEN moves THEN p.status ELSE retention_status END AS retention_status, CASE WHEN moves THEN p.series ELSE source END AS series_key, CASE WHEN moves THEN p.id END AS canonical_doc_id,
  CASE WHEN moves THEN 'retained_by_parent_relation' ELSE 'own' END AS retention_reason FROM m"""
)
def j15_retained_by_parent(spark, sf):
    i, none = F.col("doc_id"), F.lit(None).cast("long")
    docs = _retained(spark, sf).select("doc_id", "document_kind", "publish_date", "retention_status", F.lit("accepted").alias("quality_status"), F.when(i % 5 == 3, "attachment").otherwise("article").alias("document_type"), F.col("source").alias("series_key"), none.alias("canonical_doc_id"), F.lit("own").alias("retention_reason"))
    edges = docs.where("doc_id % 5 = 3").select(F.explode(F.array(i - 1, i - 2)).alias("parent_doc_id"), i.alias("child_doc_id"))
    return catalog.retained_by_parent(docs, edges).select("doc_id", "retention_status", "series_key", "canonical_doc_id", "retention_reason")


@query(
    f"""{SQL_RETAINED}, t AS (SELECT doc_id::VARCHAR AS doc_id, 'topic' || (doc_id % 97) AS topic_key, document_kind, retention_status, doc_id AS i FROM r), u AS (SELECT topic_key, min(doc_id) AS parent FROM t WHERE document_kind = 'policy' AND retention_status = 'active' GROUP BY topic_key HAVING count(*) = 1)
SELECT left(sha256('https://a.example/' || i), 12) AS parent, doc_id AS child, 'seed related_official_url' AS evidence, 1.0::DOUBLE AS confidence FROM t WHERE i % 4 = 0
UNION ALL SELECT parent, doc_id, 'topic_key 唯一匹配: ' || topic_key, 0.7::DOUBLE FROM t JOIN u USING (topic_key) WHERE i % 4 = 1 AND parent <> doc_id"""
)
def j13_explains(spark, sf):
    i = F.col("doc_id")
    docs = _retained(spark, sf).select(i.alias("i"), i.cast("string").alias("doc_id"), F.concat(F.lit("topic"), (i % 97).cast("string")).alias("topic_key"), "document_kind", "retention_status", F.lit("accepted").alias("quality_status"), F.lit("site").alias("source_type"))
    articles = docs.where("i % 4 < 2").select("doc_id", F.when(F.col("i") % 4 == 0, F.concat(F.lit("https://a.example/"), F.col("i").cast("string"))).alias("related_url"))
    return catalog.explains(articles, docs, ("site",))


@query("SELECT doc_id, 'missing' AS change FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0 UNION ALL SELECT doc_id, 'revoked' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 = 0")
def o04_allow_list_changes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return catalog.allow_list_changes(docs.where("doc_id % 3 != 0"), docs.where("doc_id % 4 != 0"), docs.where("doc_id % 5 = 0"), "doc_id")


@query(
    f"""WITH {SQL_CATALOG} SELECT source, count(*) AS n, arg_max(doc_id, row(doc_id % 3 = 0, publish_date, length(text), has_attachment, doc_id)) AS canonical_doc_id FROM catalog GROUP BY source HAVING count(*) > 1"""
)
def w03_index_canonical(spark, sf):
    docs = views.catalog(spark, sf).withColumn("validity_status", F.when(F.col("doc_id") % 3 == 0, "current").otherwise("unknown")).withColumnRenamed("has_attachment", "is_attachment")
    return catalog.index_canonical(docs, "source")


@query(
    f"""WITH {SQL_CATALOG}, e AS (SELECT doc_id // 4 AS doc_id, doc_id % 3 AS priority, doc_id AS pos, publish_date AS date, CASE WHEN doc_id % 2 = 0 THEN 0.95 ELSE 0.5 END AS confidence FROM catalog)
SELECT doc_id, arg_min(date, row(priority, pos)) AS date, count(DISTINCT date) FILTER (confidence >= 0.9) > 1 AS conflict FROM e GROUP BY doc_id"""
)
def t08_published(spark, sf):
    """T-08, X-41."""
    i = F.col("doc_id")
    evidence = views.catalog(spark, sf).select(F.floor(i / 4).alias("doc_id"), (i % 3).alias("priority"), i.alias("pos"), F.col("publish_date").alias("date"), F.when(i % 2 == 0, 0.95).otherwise(0.5).alias("confidence"))
    return catalog.published(evidence)


@query(
    """WITH h AS (SELECT doc_id % 40 AS question_id, doc_id // 3 AS doc_id, min(doc_id * 7919 % 1009 * 100000 + doc_id) AS rank FROM documents GROUP BY ALL)
SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM h QUALIFY place <= 3"""
)
def w07_first_documents(spark, sf):
    i = F.col("doc_id")
    hits = table(spark, sf, "documents").select((i % 40).alias("question_id"), F.floor(i / 3).alias("doc_id"), (i * 7919 % 1009 * 100000 + i).alias("rank"))
    return evaluation.first_documents(hits)

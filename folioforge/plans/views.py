"""Catalog, questions and answers derived from the shared tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("policy", "procedure", "faq", "annual_notice", "form", "manual", "service_guide", "public_list", "news", "event", "promotion", "incomplete")
POLICIES = ("recent_5_school_years", "recent_2_school_years", "current_school_year", "all_history", "archive_only")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    date = F.format_string("%d-%02d-%02d", 2015 + i % 11, 1 + i % 12, 1 + i % 28)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", "\n", 2)[0].alias("title"), "text", "lang", "source", F.when(i % 7 == 0, "unknown").otherwise(date).alias("publish_date"), _pick(KINDS, i % 12).alias("document_kind"),
        _pick(POLICIES, F.floor(i / 12) % 5).alias("time_policy"), F.when(i % 5 == 3, i - 1).alias("parent_doc_id"), (i % 4 == 0).alias("has_attachment"),
    )


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL_CATALOG = f"""catalog AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text, lang, source,
  CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE format('{{}}-{{:02d}}-{{:02d}}', 2015 + doc_id % 11, 1 + doc_id % 12, 1 + doc_id % 28) END AS publish_date,
  {_list(KINDS)}[doc_id % 12 + 1] AS document_kind, {_list(POLICIES)}[(doc_id // 12) % 5 + 1] AS time_policy,
  CASE WHEN doc_id % 5 = 3 THEN doc_id - 1 END AS parent_doc_id, doc_id % 4 = 0 AS has_attachment FROM documents)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as an append-only log: one to three versions a document."""
    c = catalog(spark, sf_dir).select("doc_id", "title", "publish_date", "document_kind")
    c = c.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3)))
    return c.select("doc_id", (F.col("k") * 10_000_000 + F.col("doc_id")).alias("seq"), F.concat_ws(" v", "title", F.col("k").cast("string")).alias("title"), "document_kind", F.when((F.col("doc_id") + F.col("k")) % 4 == 0, "quarantined").otherwise("accepted").alias("quality_status"))


SQL_LOG = """log AS (SELECT doc_id, k * 10000000 + doc_id AS seq, title || ' v' || k AS title, document_kind,
  CASE WHEN (doc_id + k) % 4 = 0 THEN 'quarantined' ELSE 'accepted' END AS quality_status
  FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS k FROM catalog))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each benchmark item: its words of four letters and more, two wanted sources, a scene."""
    i = F.col("item_id")
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}{4,})"), F.lit(1))
    source = lambda k: F.concat(F.lit("src"), ((i + k) % 20).cast("string"))
    return table(spark, sf_dir, "benchmark").select(i.alias("question_id"), "text", F.array(source(0), source(7)).alias("domains"), F.array_distinct(words).alias("terms"), F.concat(F.lit("scene"), (i % 11).cast("string")).alias("scene"))


SQL_QUESTIONS = r"""words AS (SELECT item_id, word, min(pos) AS pos FROM (SELECT item_id, unnest(regexp_extract_all(text, '\p{L}{4,}')) AS word, generate_subscripts(regexp_extract_all(text, '\p{L}{4,}'), 1) AS pos FROM benchmark) GROUP BY ALL),
qterms AS (SELECT item_id AS question_id, list(word ORDER BY pos) AS terms FROM words GROUP BY item_id),
questions AS (SELECT item_id AS question_id, text, ['src' || (item_id % 20), 'src' || ((item_id + 7) % 20)] AS domains, coalesce(terms, []) AS terms, 'scene' || (item_id % 11) AS scene
  FROM benchmark LEFT JOIN qterms ON item_id = question_id)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers with citations placed by rule."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.col("conv_id") % 4 + 1
    tag = F.concat(F.lit("["), (F.col("turn") % 5 + 1).cast("string"), F.lit("]"))
    text = F.concat(F.regexp_replace("text", r"\. ", F.concat(tag, F.lit("; "))), F.when(F.col("conv_id") % 3 == 0, F.lit(" [2021] 11")).otherwise(""))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), n.alias("n_refs"), text.alias("text"))


SQL_ANSWERS = r"""answers AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id % 4 + 1 AS n_refs,
  replace(text, '. ', '[' || (turn % 5 + 1) || ']; ') || CASE WHEN conv_id % 3 = 0 THEN ' [2021] 11' ELSE '' END AS text FROM conversations WHERE role = 'assistant')"""

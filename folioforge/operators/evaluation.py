"""Coverage of question banks, answer reports, release gates and corpus audits, each as aggregates over detail rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import excerpt, terms
from folioforge.operators.patterns import matches
from folioforge.operators.retrieval import QUESTIONS, small, spread
from folioforge.storage import cut


def coverage_hits(questions: DataFrame, docs: DataFrame, keep: int = 5) -> DataFrame:
    """Best documents of each question: ``question_id, doc_id, n_terms, score, rank``.

    ``questions`` has question_id, domains, terms (arrays); ``docs`` has doc_id, domain, text, publish_date. Score is
    2 for a wanted domain plus one for each term in the text; kept are domain hits with at least two terms, ranked by
    score, publish_date as text, then smaller doc_id. All terms are found in one pass over the texts of wanted domains; questions
    meet (document, term) pairs, not documents.
    """
    wanted = questions.select("question_id", F.explode(F.array_distinct("domains")).alias("domain"), F.array_distinct("terms").alias("terms"))
    asked = cut(wanted.select("question_id", "domain", F.explode("terms").alias("pattern")), "asked_terms")
    mine = spread(docs.select("doc_id", "domain", "text", "publish_date")).join(small(asked.select("domain").distinct()), "domain", "left_semi")
    keyed = mine.select(F.struct("doc_id", "domain", "publish_date").alias("doc"), "text")
    pairs = matches(keyed, asked, "doc").select("doc.*", "pattern")
    scored = pairs.join(small(asked, 20 * QUESTIONS), ["domain", "pattern"]).groupBy("question_id", "doc_id", "publish_date").agg(F.count("*").cast("int").alias("n_terms")).where("n_terms >= 2").withColumn("score", F.col("n_terms") + 2)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("publish_date"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def point_evidence(hits: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """For each (question_id, point) the best-ranked hit whose text holds it, with an excerpt."""
    met = hits.select("question_id", "doc_id", "rank").join(small(points), "question_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("point")))
    best = met.withColumn("_r", F.row_number().over(Window.partitionBy("question_id", "point").orderBy("rank"))).where("_r = 1")
    return best.select("question_id", "point", "doc_id", excerpt(F.col("text"), F.col("point")).alias("excerpt"))


def question_status(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``answerable`` with a hit of five terms, ``partial`` with any hit, else ``not_answerable``."""
    best = hits.groupBy("question_id").agg(F.max("n_terms").alias("best"), F.count("*").alias("n_hits"))
    state = F.when(F.col("best") >= 5, "answerable").when(F.col("best").isNotNull(), "partial").otherwise("not_answerable")
    return questions.select("question_id", "scene").join(best, "question_id", "left").select("question_id", "scene", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), state.alias("status"))


def scene_statistics(statuses: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return statuses.groupBy("scene").agg(F.count("*").alias("total"), count("answerable"), count("partial"), count("not_answerable"), F.round(F.count_if(F.col("status") == "answerable") / F.count("*"), 6).alias("rate"))


def gates(facts: DataFrame, limits: dict[str, tuple[str, str, float]]) -> DataFrame:
    """``gate, value, passed`` and a last row ``all`` from one row of facts; a null value fails.

    ``limits`` maps a gate to (fact, comparison, limit) with comparisons ``>=``, ``<=`` and ``==``.
    """
    test = {">=": lambda c, x: c >= x, "<=": lambda c, x: c <= x, "==": lambda c, x: c == x}
    rows = [F.struct(F.lit(g).alias("gate"), F.col(f).cast("double").alias("value"), F.coalesce(test[op](F.col(f).cast("double"), x), F.lit(False)).alias("passed")) for g, (f, op, x) in limits.items()]
    every = F.forall(F.col("g"), lambda r: r["passed"])
    whole = F.struct(F.lit("all").alias("gate"), F.lit(None).cast("double").alias("value"), every.alias("passed"))
    return facts.select(F.array(*rows).alias("g")).select(F.inline(F.concat("g", F.array(whole))))


def rates(rows: DataFrame, expected: str, given: str) -> DataFrame:
    """Hit and refusal rates of answers; null for a class without rows."""
    return rows.agg(F.avg(F.when(F.col(expected), F.col(given).cast("int"))).alias("hit_rate"), F.avg(F.when(~F.col(expected), (~F.col(given)).cast("int"))).alias("refusal_rate"))


def question_terms(text: F.Column) -> F.Column:
    """Distinct tokens; those of more than four characters are replaced by their character pairs."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: t.substr(i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(terms(text), lambda t: F.when(F.length(t) <= 4, F.array(t)).otherwise(pairs(t)))))


def sentences(text: F.Column) -> F.Column:
    """Pieces that end with a sentence mark, and a last one without."""
    return F.filter(F.split(text, r"(?<=[。！？!?；;\n])"), lambda s: s != "")


def gated_stream(answers: DataFrame, refs: F.Column) -> DataFrame:
    """Sentences that may be sent: those before the first one with a reference out of range. ``answer_id, pos, sentence``."""
    s = answers.select("answer_id", "n_refs", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    bad = F.size(F.filter(refs, lambda r: (r < 1) | (r > F.col("n_refs")))) > 0
    seen = F.max(bad).over(Window.partitionBy("answer_id").orderBy("pos"))
    return s.withColumn("_bad", seen).where("not _bad").select("answer_id", "pos", "sentence")


def longest_alias(texts: DataFrame, aliases: DataFrame, text: str = "title") -> DataFrame:
    """The unit whose alias is the longest one inside the text; of equally long ones the first in ``position``."""
    met = texts.join(small(aliases, 10_000), F.contains(F.col(text), F.col("alias")))
    return met.groupBy(*texts.columns).agg(F.max_by("unit", F.struct(F.length("alias"), -F.col("position"))).alias("unit"))


def timeline(rows: DataFrame, stamp: str) -> DataFrame:
    return rows.groupBy(F.substring(F.date_format(stamp, "yyyy-MM-dd"), 1, 10).alias("day")).agg(F.count("*").alias("n"))


def fingerprint(rows: DataFrame, line: F.Column, order: str) -> DataFrame:
    """SHA-256 of all lines in order. For reports and metadata rows, whose number is bounded by their kind."""
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("fingerprint"))


def series_counts(docs: DataFrame) -> DataFrame:
    """One row: annual series, those with several documents, and those with several active ones."""
    series = docs.where("temporal_class = 'annual'").groupBy("series_key").agg(F.count("*").alias("n"), F.count_if(F.col("retention_status") == "active").alias("active"))
    return series.agg(F.count("*").alias("annual_series"), F.count_if(F.col("n") > 1).alias("duplicate_series"), F.count_if(F.col("active") > 1).alias("duplicate_active_series"))


def invalid_chunks(chunks: DataFrame, wanted: F.Column) -> DataFrame:
    """``collection, doc_id`` of documents with a chunk in another collection than the ``wanted`` one."""
    return chunks.where(~F.coalesce(F.col("collection") == wanted, F.lit(False))).select("collection", "doc_id").distinct()


def collection_stats(chunks: DataFrame, wanted: F.Column) -> DataFrame:
    """Chunks, documents and invalid documents by collection; ``invalid_chunks`` names the latter."""
    invalid = F.when(~F.coalesce(F.col("collection") == wanted, F.lit(False)), F.lit(1))
    docs = chunks.groupBy("collection", "doc_id").agg(F.count("*").alias("n"), F.max(invalid).alias("invalid"))
    return docs.groupBy("collection").agg(F.sum("n").alias("chunk_count"), F.count("*").alias("document_count"), F.count("invalid").alias("invalid_documents"))


def family_hits(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``question_id, hit``: whether a hit or its parent is an expected document, for every question that expects one."""
    named = hits.select("question_id", "doc_id").union(hits.where("parent_doc_id is not null").select("question_id", "parent_doc_id"))
    found = expected.join(named, ["question_id", "doc_id"], "left_semi").select("question_id", F.lit(True).alias("hit"))
    return found.union(expected.select("question_id", F.lit(False))).groupBy("question_id").agg(F.max("hit").alias("hit"))


def first_documents(hits: DataFrame, keep: int = 3) -> DataFrame:
    """The first distinct documents of each question in rank order: ``question_id, doc_id, place``."""
    first = hits.groupBy("question_id", "doc_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "doc_id")).cast("long")
    return first.withColumn("place", place).where(F.col("place") <= keep).select("question_id", "doc_id", "place")

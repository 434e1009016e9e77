"""Reports, resolutions and guards over catalogs, question banks, answers and crawl logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import canonical_json
from folioforge.operators.patterns import matches

#: Reasons that count as news and as copies in topic statistics.
NEWS_REASONS, COPY_REASONS = ("news_noise", "strong_exclude", "no_facts"), ("duplicate", "duplicate_text_hash")
#: States in which a document may be found.
FOUND_STATES = ("active", "historical")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def topic_stats(decisions: DataFrame) -> DataFrame:
    """Outcomes by topic of ``topic, decision, reason, retention``; no topic counts as ``其他``."""
    accepted = F.col("decision") == "accept"
    news, copies = (~accepted & F.coalesce(F.col("reason"), F.lit("")).isin(*r) for r in (NEWS_REASONS, COPY_REASONS))
    topic = F.coalesce(F.nullif("topic", F.lit("")), F.lit("其他")).alias("topic")
    count = lambda c: F.count(F.when(c, 1))
    return decisions.groupBy(topic).agg(
        F.count("*").alias("discovered"), count(accepted).alias("accepted"), count(accepted & (F.col("retention") == "historical")).alias("historical"),
        count(news).alias("news_rejected"), count(copies).alias("duplicate"), count(~accepted & ~news & ~copies).alias("other_rejected"),
    )


def gate_failures(rates: DataFrame, least_hit: float, least_refusal: float, least_answer: float = 1.0) -> DataFrame:
    """Names of the gates that a row of ``n, hit_rate, refusal_rate, answer_rate`` fails; an empty set or a missing class fails."""
    checks = [
        F.when(F.col("hit_rate").isNull(), "no_answerable").when(F.col("hit_rate") < least_hit, "hit_rate"),
        F.when(F.col("refusal_rate").isNull(), "no_refusable").when(F.col("refusal_rate") < least_refusal, "refusal_rate"),
        F.when(F.col("answer_rate") < least_answer, "answer_rate"),
    ]
    return rates.withColumn("failures", F.when(F.col("n") == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*checks))))


def extended_domains(expected: Column, hits: Column, status: Column, suffix: str) -> Column:
    """``expected, review``: sources off the expected ones join them if all hits end in ``suffix``; else a person must look."""
    found = F.array_sort(F.array_distinct(F.filter(hits, lambda d: d.isNotNull() & (d != ""))))
    off, official = status == "answerable_offdomain", (F.size(found) > 0) & F.forall(found, lambda d: F.endswith(d, F.lit(suffix)))
    more = F.array_sort(F.array_union(F.coalesce(expected, F.array().cast("array<string>")), found))
    return F.struct(F.when(off & official, more).otherwise(expected).alias("expected"), F.when(off, F.when(official, "auto_extended").otherwise("manual")).otherwise("").alias("review"))


def shared_domains(expected: Column, hits: Column) -> Column:
    """``domains, matched``: which expected domains were hit, in sorted order."""
    both = F.array_sort(F.array_intersect(expected, hits))
    return F.struct(both.alias("domains"), (F.size(both) > 0).alias("matched"))


def ground_bank(bank: DataFrame, decisions: DataFrame) -> DataFrame:
    """Questions that were probed, with ``status`` and ``reason``; those to refuse or to clarify are grounded as they are."""
    plain = F.coalesce(F.col("should_refuse"), F.lit(False)) | F.coalesce(F.col("needs_clarification"), F.lit(False))
    both = bank.join(decisions.select("question_id", F.col("status").alias("decided"), F.col("reason").alias("why")), "question_id")
    grounded = plain | (F.col("decided") == "grounded")
    return both.select(*bank.columns, F.when(grounded, "grounded").otherwise("needs_docs").alias("status"), F.when(grounded, "").otherwise(F.col("why")).alias("reason"))


def attribute_units(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``doc_id, unit_id, via``: the unit whose name is the publisher, else the one with the longest name in the title.

    ``units`` has ``unit_id, name, place``; of names of one length the first place wins. All names are found in one pass over the titles, whatever their number.
    """
    named = units.where("name <> ''")
    owner = named.groupBy("name").agg(F.min_by("unit_id", "place").alias("owner"))
    exact = docs.select("doc_id", "title", F.trim(F.coalesce("publisher", F.lit(""))).alias("name")).join(owner, "name", "left")
    titles = exact.where("owner is null").select("doc_id", F.col("title").alias("text"))
    rank = F.struct(F.length("name"), -F.col("place"))
    inside = matches(titles, named.select(F.col("name").alias("pattern"))).withColumnRenamed("pattern", "name").join(named, "name").groupBy("doc_id").agg(F.max_by("unit_id", rank).alias("inside"))
    out = exact.join(inside, "doc_id", "left")
    return out.select("doc_id", F.coalesce("owner", "inside").alias("unit_id"), F.when(F.col("owner").isNotNull(), "publisher").when(F.col("inside").isNotNull(), "title").otherwise("none").alias("via"))


def with_policy(docs: DataFrame, policies: DataFrame, default: Column) -> DataFrame:
    """``time_policy`` by publisher and section, else the default of the kind."""
    found = policies.select("publisher", "section", F.col("time_policy").alias("found"))
    return docs.join(found, ["publisher", "section"], "left").withColumn("time_policy", F.coalesce("found", default)).drop("found")


def primary_sources(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """``answer_id, source_doc_id``: the first of an answer's source ids that exists; null where none does."""
    each = answers.select("answer_id", F.posexplode_outer("source_doc_ids").alias("pos", "doc_id"))
    here = each.join(docs.select("doc_id").distinct().withColumn("here", F.lit(True)), "doc_id", "left")
    return here.groupBy("answer_id").agg(F.min_by("doc_id", F.when(F.col("here"), F.col("pos"))).alias("source_doc_id"))


def merge_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answer's status, ``missing`` without one. Answers that repeat a question or belong to none are refused."""
    twice = answers.groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1")
    strange = answers.join(questions, "question_id", "left_anti")
    if not twice.isEmpty() or not strange.isEmpty():
        raise ValueError("answers do not fit the questions")
    return questions.join(answers, "question_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def apply_versions(docs: DataFrame, relations: DataFrame) -> DataFrame:
    """Documents with sorted ``supersedes`` and ``superseded_by`` after new relations (newer, older), old ones kept."""
    empty = F.array().cast("array<long>")
    down = relations.groupBy(F.col("newer").alias("doc_id")).agg(F.collect_set("older").alias("down"))
    up = relations.groupBy(F.col("older").alias("doc_id")).agg(F.collect_set("newer").alias("up"))
    out = docs.join(down, "doc_id", "left").join(up, "doc_id", "left")
    both = lambda old, new: F.array_sort(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)))
    out = out.withColumn("supersedes", both(F.col("supersedes"), F.col("down"))).withColumn("superseded_by", both(F.col("superseded_by"), F.col("up")))
    return out.withColumn("validity_status", F.when(F.size("superseded_by") > 0, "superseded").when(F.size("supersedes") > 0, "current").otherwise(F.col("validity_status"))).drop("down", "up")


def reset_versions(docs: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without derived version fields, and relations other than ``supersedes``."""
    none = F.array().cast("array<long>")
    return docs.withColumns({"supersedes": none, "superseded_by": none, "validity_status": F.lit("unknown_validity")}), relations.where("relation <> 'supersedes'")


def is_family(a_id: Column, a_parent: Column, b_id: Column, b_parent: Column) -> Column:
    """Parent and child, or children of one parent."""
    return F.coalesce(a_id == b_parent, F.lit(False)) | F.coalesce(b_id == a_parent, F.lit(False)) | F.coalesce(a_parent == b_parent, F.lit(False))


def stop_of_crawl(pages: DataFrame, key: str, order: str, links: str, new_links: str) -> DataFrame:
    """``stop_at, stop_reason`` of each list: the first page that ends two empty pages in a row, or two without new links."""
    w = Window.partitionBy(key).orderBy(order)
    two = lambda c: (F.col(c) == 0) & (F.lag(c).over(w) == 0)
    ends = pages.select(key, order, F.when(two(links), "empty_pages").when(two(new_links), "no_new_articles").alias("stop_reason")).where("stop_reason is not null")
    return ends.groupBy(key).agg(F.min(order).alias("stop_at"), F.min_by("stop_reason", order).alias("stop_reason"))


def latest_candidate(candidates: DataFrame, key: str = "attachment") -> DataFrame:
    """Of an attachment's pages the one with the greatest date text, the earliest found first."""
    return candidates.groupBy(key).agg(F.max_by("doc_id", F.struct("publish_date", -F.col("seq"))).alias("doc_id"))


def capped_secondary(hits: DataFrame, most: int = 3) -> DataFrame:
    """Hits of the primary collection, and the best ``most`` of every other, by ``question_id, collection, is_primary, score, doc_id``."""
    place = F.row_number().over(Window.partitionBy("question_id", "collection").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("place", place).where(F.col("is_primary") | (F.col("place") <= most))


def admitted(docs: DataFrame, collection_of) -> DataFrame:
    """Documents that go into an index, with their collection: accepted, with a body, of a kind that is routed.

    Superseded and historical ones are historical whatever their retention says.
    """
    kept = F.when(F.col("validity_status").isin("historical", "superseded"), "historical").otherwise(F.col("retention_status"))
    rows = docs.where((F.coalesce(F.col("quality_status"), F.lit("accepted")) == "accepted") & (F.col("body") != "")).withColumn("retention_status", kept)
    return rows.withColumn("collection", collection_of(F.col("document_kind"), F.col("retention_status"))).where("collection is not null")


def indexed_documents(chunks: DataFrame) -> DataFrame:
    """``collection, doc_id``, signatures and chunk count of what an index holds."""
    return chunks.groupBy("collection", "doc_id").agg(F.max("signature").alias("signature"), F.count("*").alias("chunks"))


def collection_names(keys: Column, names: dict[str, str]) -> Column:
    """The stored name of a collection key; a key that is not known is an error."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.when(keys.isNotNull(), F.coalesce(known[keys], F.raise_error(F.concat(F.lit("unknown collection "), keys)).cast("string")))


def payload(docs: DataFrame) -> DataFrame:
    """What an administrator sees of documents, with ``has_body, body_bytes, is_searchable``."""
    has = F.coalesce(F.col("body"), F.lit("")) != ""
    found = has & (F.col("quality_status") == "accepted") & F.col("retention_status").isin(*FOUND_STATES) & (F.col("index_collection") != "none")
    return docs.select(*(c for c in docs.columns if c != "body"), has.alias("has_body"), F.octet_length(F.coalesce("body", F.lit(""))).cast("long").alias("body_bytes"), F.coalesce(found, F.lit(False)).alias("is_searchable"))


def version_of(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest logged row of each wanted (doc_id, content_hash); ``restorable`` tells whether its body still has that hash."""
    hit = log.join(wanted, ["doc_id", "content_hash"])
    newest = F.row_number().over(Window.partitionBy("doc_id", "content_hash").orderBy(F.desc("seq")))
    return hit.withColumn("_r", newest).where("_r = 1").drop("_r").withColumn("restorable", F.coalesce(F.sha2("body", 256) == F.col("content_hash"), F.lit(False)))


def recent(rows: DataFrame, n: int = 30, seq: str = "seq") -> DataFrame:
    """The last ``n`` rows of a log, newest first."""
    return rows.orderBy(F.desc(seq)).limit(n)


def upsert(state: DataFrame, fresh: DataFrame, key: str = "url") -> DataFrame:
    """State after fields of ``fresh`` replaced theirs; null fields leave what was there, and keys that are new come in."""
    names = [c for c in state.columns if c != key]
    a, b = state.alias("a"), fresh.select(key, *names).alias("b")
    return a.join(b, key, "full").select(key, *(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in names))


def conditional_headers(etag: Column, modified: Column) -> Column:
    """Request headers of a conditional fetch, for what is known of the last answer."""
    one = lambda n, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c))
    return F.array_compact(F.array(one("If-None-Match", etag), one("If-Modified-Since", modified)))


def context(hits: DataFrame) -> DataFrame:
    """One prompt context a question: hits numbered by place, each with title, heading, publisher and date, then its text."""
    heading = F.when(F.coalesce(F.col("heading"), F.lit("")) != "", F.concat(F.lit(" "), "heading")).otherwise("")
    block = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] 《"), "title", F.lit("》"), heading, F.lit("（"), "publisher", F.lit("，发布于 "), "publish_date", F.lit("）\n"), "text")
    blocks = F.array_sort(F.collect_list(F.struct("place", block.alias("block"))))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"), F.count("*").alias("n_sources"))


def offline_answer(n: Column, confident: Column, refusal: str) -> Column:
    """A deterministic answer that cites ``n`` sources; the refusal where retrieval was not confident."""
    refs = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda k: F.concat(F.lit("["), k.cast("string"), F.lit("]"))), "")
    return F.when(confident & (n > 0), F.concat(F.lit("offline answer "), refs)).otherwise(refusal)


def resumed(bank: DataFrame, done: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Questions still to answer. Earlier results with an unknown status or a repeated question are refused."""
    bad = done.where(~F.col("status").isin(*statuses)).limit(1).union(done.groupBy("question_id").agg(F.count("*").alias("status")).where("status > 1").select(*done.columns).limit(1))
    if not bad.isEmpty():
        raise ValueError("results that cannot be resumed from")
    return bank.join(done, "question_id", "left_anti")


def filtered_listing(rows: DataFrame, title: str = "title", include: str = "include", exclude: str = "exclude") -> DataFrame:
    """Rows whose title matches their section's ``include`` and not its ``exclude`` pattern; null and empty ones match all and none."""
    t = F.coalesce(F.col(title), F.lit(""))
    wanted = (F.coalesce(F.col(include), F.lit("")) == "") | F.regexp_like(t, F.col(include))
    spared = (F.coalesce(F.col(exclude), F.lit("")) == "") | ~F.regexp_like(t, F.col(exclude))
    return rows.where(wanted & spared)


def scene_of(domain: Column, text: Column, by_domain: dict[str, str], special: tuple[tuple[str, tuple[str, ...], str], ...]) -> Column:
    """A document's scene: the first special (domain, terms, scene) whose domain is its and one of whose terms it holds, else its domain's."""
    found = F.create_map(*(F.lit(x) for kv in by_domain.items() for x in kv))[domain]
    for where, terms, scene in reversed(special):
        held = F.lit(False)
        for t in terms:
            held = held | F.contains(text, F.lit(t))
        found = F.when((domain == where) & held, scene).otherwise(found)
    return found


def may_publish(fingerprint: Column, audited: Column, published: Column, blockers: Column) -> Column:
    """``state``: a release needs a fresh audit without blockers, and something new."""
    return F.when(F.coalesce(fingerprint != audited, F.lit(True)), "stale").when(blockers > 0, "blocked").when(F.coalesce(fingerprint == published, F.lit(False)), "published").otherwise("ready")


def sse(event: Column, data: Column) -> Column:
    """A server-sent event of one JSON line; null data is a JSON null."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), canonical_json({"text": data}), F.lit("\n\n"))


def feedback(question: Column, answer: Column, most: int = 500) -> Column:
    return F.struct(F.left(question, F.lit(most)).alias("question"), F.left(answer, F.lit(most)).alias("answer"))

"""Which edition of a document supersedes which: greedy one-to-one pairs inside a group, newest first."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import web
from folioforge.functions.text import iso_date

#: Wording that proves a newer edition, the mark of an edition in a title, and words of the results.
EVIDENCE = (r"同时废止[^。；\n]{0,30}", r"原《[^》]+》[^。；\n]{0,12}废止", r"自[^。；\n]{2,30}(?:起)?(?:施行|实施|生效)", r"以本(?:办法|规定|细则|通知|章程)为准")
REVISED = "修订"
EDITION = r"（[^）]*(?:修订|修订稿|修订版)[^）]*）"
LEAST_NAME = 6
BY_TITLE = "标题版本标记："
UNKNOWN_EVIDENCE = "仅发现年份/标题相似，缺少明确施行、修订或废止证据"
RELATIONS = "source_doc_id {id}, target_doc_id {id}, relation string, status string, confidence double, evidence string"


def superseding(docs: DataFrame, group: str = "group_key") -> DataFrame:
    """``group_key, newer, older`` for documents with a date, paired off from the newest down.

    In each group the strictly newer edition supersedes the next older one, both are used up, and the walk goes on
    with the rest; editions of one day never pair. In date order that is pairing neighbours, so no group is held in memory.
    """
    day = iso_date(F.col("publish_date"))
    dated = docs.where(day.isNotNull()).select(group, "doc_id", day.alias("day"))
    # one edition of each day can take part in a pair with another day
    one = dated.groupBy(group, "day").agg(F.max("doc_id").alias("doc_id"))
    w = Window.partitionBy(group).orderBy(F.desc("day"))
    ranked = one.withColumn("r", F.row_number().over(w)).withColumn("older", F.lead("doc_id").over(w))
    return ranked.where("r % 2 = 1 and older is not null").select(group, F.col("doc_id").alias("newer"), "older")


def policy_name(title: F.Column) -> F.Column:
    """The quoted name of a title, or the title without announcement words and edition marks."""
    t = F.regexp_replace(F.regexp_replace(title, r"(?U)\s+", ""), "^[ ：:，,。]+|[ ：:，,。]+$", "")
    quoted = F.regexp_extract(t, "《([^》]+)》", 1)
    t = F.when(quoted != "", quoted).otherwise(t)
    for pattern in ("^关于(?:印发|修订|制定|出台|发布|实施)?", "(?:的通知|通知|公告)$", "^关于", "（(?:修订|试行|暂行|修订稿)[^）]*）$", "^[ ：:，,。]+|[ ：:，,。]+$"):
        t = F.regexp_replace(t, pattern, "")
    return t


def version_relations(docs: DataFrame) -> DataFrame:
    """Relations ``supersedes`` and ``version_unknown`` of ``doc_id, title, body, publish_date, policy_name, parent_doc_id``.

    Documents of one normalised name, newest first and then by doc_id, are paired greedily: an edition supersedes the
    first strictly older one that is free, no relative, and for which its text names that edition with words of
    validity, or its title has an edition mark. Each takes part in one pair; the others of a name that several
    documents share get ``version_unknown`` with a null target. A null text or date counts as empty.

    Bodies leave the scan only where they hold evidence; the pairing streams light rows in order and holds the editions
    that still wait for an older one, not the group.
    """
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.when(of("policy_name") != "", F.col("policy_name")).otherwise(policy_name(of("title")))
    text = F.concat(of("title"), F.lit("\n"), of("body"))
    proofs = F.filter(F.array(*(F.regexp_extract(text, p, 0) for p in EVIDENCE)), lambda x: x != "")
    known = docs.select(
        web.version_key(name, F.col("doc_id").cast("string")).alias("group_key"), "doc_id", of("publish_date").alias("date"), "parent_doc_id",
        F.regexp_replace(name, web.EXTENSION, "").alias("core"), proofs.alias("proofs"), F.contains(text, F.lit(REVISED)).alias("revised"), F.regexp_extract(of("title"), EDITION, 0).alias("mark"), text.alias("text"),
    )
    row = F.xxhash64("doc_id", "date", "text").alias("row")
    cores = known.where(F.length("core") >= LEAST_NAME).groupBy("group_key").agg(F.collect_set("core").alias("cores"))
    proving = known.where("size(proofs) > 0 or revised").select("group_key", "doc_id", row, "text").join(cores, "group_key")
    held = proving.select("doc_id", "row", F.filter("cores", lambda c: F.contains(F.col("text"), c)).alias("held")).dropDuplicates(["doc_id", "row"])
    light = known.select("*", row).drop("text").join(held, ["doc_id", "row"], "left").drop("row")
    ordered = light.repartition("group_key").sortWithinPartitions("group_key", F.desc("date"), "doc_id")
    return ordered.mapInPandas(_paired, RELATIONS.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The greedy pairs of rows sorted by group and age. A doc goes to the earliest waiting edition that may supersede it."""
    group, size, first = None, 0, []
    marked: dict[int, object] = {}
    naming: dict[str, dict[int, object]] = {}

    def unknown(r) -> tuple:
        return r.doc_id, None, "version_unknown", "unknown_validity", 0.0, UNKNOWN_EVIDENCE

    def waiting() -> list:
        every = dict(marked)
        for queue in naming.values():
            every |= queue
        return [unknown(r) for _, r in sorted(every.items())] if size > 1 else []

    def may(old, new) -> bool:
        parents = {p for p in (old.parent_doc_id, new.parent_doc_id) if not pd.isna(p) and p != ""}
        same = len(parents) == 1 and not pd.isna(old.parent_doc_id) and not pd.isna(new.parent_doc_id) and old.parent_doc_id == new.parent_doc_id
        return new.date > old.date and new.doc_id != old.parent_doc_id and old.doc_id != new.parent_doc_id and not same

    for part in batches:
        out = []
        for r in part.itertuples(index=False):
            if r.group_key != group:
                out += waiting()
                group, size, first = r.group_key, 0, []
                marked.clear()
                naming.clear()
            size += 1
            if size == 2:
                out += first
            dated = re.match(r"\d{4}-\d{2}-\d{2}", r.date) is not None
            found = [next(((at, new) for at, new in queue.items() if may(r, new)), None) for queue in (naming.get(r.core, {}), marked)] if dated else []
            found = min((x for x in found if x), key=lambda x: x[0], default=None)
            if found:
                at, new = found
                named = at in naming.get(r.core, {})
                words = "；".join([*new.proofs, *([REVISED + r.core] if new.revised else [])]) if named else BY_TITLE + new.mark
                out.append((new.doc_id, r.doc_id, "supersedes", "current", 0.95, words))
                marked.pop(at, None)
                for c in _names(new):
                    naming[c].pop(at, None)
            elif dated and (r.mark or _names(r)):
                if r.mark:
                    marked[size] = r
                for c in _names(r):
                    naming.setdefault(c, {})[size] = r
            elif size == 1:
                first = [unknown(r)]
            else:
                out.append(unknown(r))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in RELATIONS.split(", ")])
    yield pd.DataFrame(waiting(), columns=[x.split()[0] for x in RELATIONS.split(", ")])


def _names(r) -> list[str]:
    return [] if r.held is None else list(r.held)

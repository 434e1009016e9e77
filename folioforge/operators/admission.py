"""Admission in order: a row is accepted if it passes all gates and no earlier accepted row holds one of its keys.

The loop that this replaces walks the rows one by one. Here rows are settled in rounds: a row that is the first open one under all of its keys is
accepted, and all open rows under its keys are settled as duplicates. A row waits only for earlier rows that share a key with it, so
the rounds are as many as the longest chain of such waits; each round is two shuffles of the rows still open. Frequent keys are
counted with map-side minima and joined where their rows lie, so a key with a third of all rows is no hot spot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.joins import join_unique
from folioforge.storage import cut


@dataclass(frozen=True)
class Gate:
    """A rule on a row alone. ``fails`` null counts as passed."""

    reason: str
    fails: Column


@dataclass(frozen=True)
class Unique:
    """At most one accepted row for each value of the column ``key``; null and empty values are no keys."""

    reason: str
    key: str


@dataclass(frozen=True)
class Admission:
    rows: DataFrame
    rounds: int


def _links(rows: DataFrame, steps: list, order: str) -> DataFrame:
    """``(order, at, key)``: the keys of each row with the step that asks for them."""
    cells = [F.when(F.col(s.key).cast("string") != "", F.struct(F.lit(i).alias("at"), F.concat(F.lit(f"{i}:"), F.col(s.key).cast("string")).alias("key"))) for i, s in enumerate(steps) if isinstance(s, Unique)]
    none = F.array().cast("array<struct<at:int,key:string>>")
    return rows.select(F.col(order).alias("row"), F.col("_failed").alias("failed"), F.inline(F.array_compact(F.array(*cells)) if cells else none))


def _settle(open_: DataFrame) -> tuple[DataFrame, int]:
    """``(key, holder, n)``: the accepted row that holds each key of more than one row, and the rounds it took."""
    spark, rounds, taken = open_.sparkSession, 0, None
    while True:
        firsts = cut(open_.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")), "firsts")
        state = cut(join_unique(open_, firsts, "key", "n"), "waiting")
        if not state.limit(1).count():
            break
        winners = cut(state.groupBy("row").agg(F.bool_and(F.col("row") == F.col("first")).alias("first_of_all")).where("first_of_all").select("row"), "winners")
        now = cut(firsts.join(winners, firsts["first"] == winners["row"]).select("key", F.col("row").alias("holder"), "n"), "taken")
        settled = join_unique(state.select("row", "key"), now, "key", "n").select("row").distinct()
        open_ = cut(state.select("row", "key").join(settled, "row", "left_anti"), "open")
        taken, rounds = now if taken is None else taken.unionByName(now), rounds + 1
    if taken is None:
        taken = spark.createDataFrame([], "key string, holder long, n long")
    return taken, rounds


def admit(rows: DataFrame, steps: list[Gate | Unique], order: str = "seq") -> Admission:
    """``rows`` with ``accepted``, ``reason`` (of the first step that it fails, null if accepted) and ``duplicate_of`` (the order of the accepted row in the way).

    ``order`` is a bigint without repeats or nulls, the order in which a loop would walk the rows; steps are judged in the order given. A row
    refused for any reason holds no keys. Rows without keys are judged by their gates alone. An empty table gives no rows and no rounds.
    """
    failed = F.coalesce(*(F.when(s.fails, F.lit(i)) for i, s in enumerate(steps) if isinstance(s, Gate)), F.lit(None).cast("int"))
    judged = cut(rows.withColumn("_failed", failed), "judged")
    links = cut(_links(judged, steps, order), "links")
    shared = cut(links.groupBy("key").agg(F.count_if(F.col("failed").isNull()).alias("open"), F.count("*").alias("n")).where("n > 1 and open > 0"), "shared")
    candidates = join_unique(links, shared.select("key", "n"), "key", "n").select("row", "at", "key", "failed")
    candidates = cut(candidates, "candidates")
    taken, rounds = _settle(candidates.where("failed is null").select("row", "key"))
    # holders of keys, with as many rows as want them, failed ones included
    taken = cut(taken.select("key", "holder").join(shared.select("key", "n"), "key"), "holders")
    met = join_unique(candidates.select("row", "at", "key"), taken, "key", "n").where("holder < row")
    first = met.groupBy("row").agg(F.min(F.struct("at", "holder")).alias("m")).select(F.col("row").alias(order), F.col("m.at").alias("_at"), F.col("m.holder").alias("_holder"))
    out = judged.join(first, order, "left")
    step = F.least(F.col("_failed"), F.col("_at"))
    reasons = F.array(*(F.lit(s.reason) for s in steps)) if steps else F.array(F.lit(""))
    out = out.withColumn("accepted", step.isNull()).withColumn("reason", F.get(reasons, step)).withColumn("duplicate_of", F.when(step == F.col("_at"), F.col("_holder")))
    return Admission(out.drop("_failed", "_at", "_holder"), rounds)


def decision_log(admitted: DataFrame) -> DataFrame:
    """``(decision, reason, n)``: how many rows each reason refused; accepted rows have an empty reason."""
    decision = F.when(F.col("accepted"), "accept").otherwise("reject").alias("decision")
    return admitted.groupBy(decision, F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))

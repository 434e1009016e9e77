"""A training-data pipeline: quality, near-duplicates, repeated passages, mixing, tokens.

Each stage takes the documents that the stage before kept and returns documents again; the last returns their tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import attention_mil, cdc_dedup, setsketch, soft_mixing
from folioforge.llm.queries import WEIGHTS, domains, held_out, table, tokenized
from folioforge.storage import cut

#: The mix is the largest in which no domain needs more than so many times the tokens that the earlier stages left of it. All shares are
#: met; the quality stage leaves little junk, of which the weights ask a share, so the domains in plenty are thinned out.
MAX_EPOCHS = 16.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of at least 0.5, each by its own text.

    Null and empty texts are scored as texts without words; without labels of both classes every row stays. Rows with a null
    doc_id are scored and never learned from. An empty table gives no rows.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    net = attention_mil.train(docs.where(~held_out()), labels)
    scored = attention_mil.score(docs.withColumn("given_id", F.col("doc_id")), net, keep=("given_id", *COLUMNS[1:])).where("score >= 0.5")
    return scored.select(F.col("given_id").alias("doc_id"), *COLUMNS[1:])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first by doc_id and text hash. Rows that share a doc_id are judged by their texts.

    Rows without words and rows with a null doc_id stay. Of rows equal in doc_id and text one stays.
    """
    return setsketch.drop_near_duplicates(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; those left without any word go.

    Every row is cut by its own text, also where rows share a doc_id. Null texts and rows with a null doc_id stay as they are.
    """
    kind = docs.schema["n_chars"].dataType
    out = cdc_dedup.remove_repeats(docs.withColumn("given_id", F.col("doc_id")), keep=("given_id", "lang", "source", "n_chars"))
    changed = F.col("removed_chars") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(F.col("given_id").alias("doc_id"), "text", "lang", "source", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its copies say, each copy a row.

    Rows that share a doc_id are rated by their texts. Null texts weigh nothing and are emitted by their rate; rows with a null
    doc_id stay once.
    """
    rates = soft_mixing.mix(docs.withColumn("key", F.xxhash64("text")), domains(table(spark, sf_dir, "labels")), WEIGHTS, max_epochs=MAX_EPOCHS, keep=("key",))
    other = rates.where("doc_id is not null and copies <> 1").select(F.col("doc_id").alias("mixed_id"), F.col("key").alias("mixed_key"), "copies").distinct()
    mine = (docs["doc_id"].cast("long") == other["mixed_id"]) & (F.xxhash64(docs["text"]) == other["mixed_key"])
    times = F.coalesce("copies", F.lit(1)).cast("int")
    return docs.join(other, mine, "left").select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the byte-level BPE ids of every document, and of their decoded bytes."""
    return tokenized(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("tokens", tokens)]

#: Learned scores and sketches have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs

"""Readers and writers of catalogs, relations, question banks and stored files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATION = T.StructType([T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType()) for n in ("parent", "child", "relation", "evidence", "confidence", "created_at")])


def read_lines(spark: SparkSession, path: str, schema: T.StructType, comments: bool = False) -> DataFrame:
    """JSON lines with ``schema``; blank and malformed lines are skipped, as are lines that begin with ``#`` if ``comments``."""
    text = spark.read.text(path).where(F.trim("value") != "")
    if comments:
        text = text.where(~F.ltrim("value").startswith("#"))
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = text.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_relations(relations: DataFrame, path: str) -> None:
    """Distinct relations in canonical order."""
    relations.distinct().orderBy("relation", "parent", "child", "evidence", "created_at").write.mode("overwrite").json(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, RELATION).distinct()


def file_kind(name: F.Column, content: F.Column) -> F.Column:
    """Kind of a file: leading bytes before the extension."""
    magic = F.hex(F.substring(content, 1, 4))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(magic == "25504446", "pdf").when(magic == "504B0304", F.when(ext.isin("docx", "xlsx", "pptx"), ext).otherwise("zip")).when(magic == "D0CF11E0", F.when(ext.isin("doc", "xls", "ppt"), ext).otherwise("ole")).otherwise(F.nullif(ext, F.lit("")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, kind, content`` of all files below a folder, without hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), file_kind(name, F.col("content")).alias("kind"), "content").where(~F.col("name").startswith("."))


def _gb18030(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def decode_html(content: F.Column) -> F.Column:
    """UTF-8 where valid, else GB18030, which Spark's own decoder lacks; unknown bytes are replaced."""
    valid = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(valid, F.pandas_udf(_gb18030, "string")(F.when(valid.isNull(), content)))


def front_matter(text: F.Column) -> tuple[F.Column, F.Column]:
    """The YAML head (empty if there is none) and the body."""
    pattern = r"(?s)\A---\s*\n(.*?)\n---\s*\n?"
    return F.regexp_extract(text, pattern, 1), F.regexp_replace(text, pattern, "")

"""Shared scratch space: lineage is cut with Parquet tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in plain local mode one of our own when it is unset.

    A machine-local folder is refused on a cluster, where other executors cannot see it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/folioforge-shared"
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later stages and retries start here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`cut` wrote in this application. Results not yet computed become unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folioforge/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

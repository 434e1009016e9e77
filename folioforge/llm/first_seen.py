"""Lines that earlier batches hold already, removed by a stream that keeps counts.

Batches of documents arrive one after the other in a watched folder. A Structured Streaming aggregation by line key, in update mode,
adds one for each document of the batch that holds the key; its state, in RocksDB, is all that is remembered. ``foreachBatch`` gets the new totals of the touched keys, subtracts
what the current batch added, and so knows how many documents of earlier batches hold each key. Keys with enough of them are joined
to the lines of the staged batch. The query is started anew for each batch, on one checkpoint.

Nothing passes one task or the driver, and tables that grow with the input are never broadcast, even where they happen to be small: keys are counted with map-side sums, frequent keys are joined where their lines lie (a broadcast of at most ``HOT_KEYS``
keys), and a document meets its removed line numbers by its row number. A batch that runs again overwrites its own folders, so a retry changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.skew import split_join
from folioforge.storage import shared_dir

#: Stripped from both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, LEAST_CHARS = 3, 1
#: A frequent key has one in so many of the lines that match; only such keys are broadcast.
HOT_KEYS = 4096
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a start has one batch; its local files go with it
}
SCHEMA = "row_no long, doc_id {id}, lines array<string>, keys array<string>, batch int"


def line_key(line: Column) -> Column:
    """What two lines must share to count as the same: blanks at both ends do not count, nor does the case of A-Z."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Folder:
    """A new folder below the shared one."""

    def __init__(self, spark: SparkSession):
        self.path = f"{shared_dir(spark)}/folioforge/{spark.sparkContext.applicationId}/first-seen-{uuid.uuid4().hex}"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def __call__(self, *names: object) -> str:
        return "/".join([self.path, *map(str, names)])

    def _of(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def make(self, path: str) -> None:
        p, fs = self._of(path)
        fs.mkdirs(p)

    def move(self, source: str, target: str) -> bool:
        """Whether there was something to move."""
        p, fs = self._of(source)
        return bool(fs.exists(p) and fs.rename(p, self._of(target)[0]))


def _increments(staged: DataFrame) -> DataFrame:
    """``(key, docs, n)``: documents and lines of one batch that hold each key."""
    held = F.filter("keys", lambda k: k.isNotNull())
    each = F.concat(F.transform(F.array_distinct(held), lambda k: F.struct(k.alias("k"), F.lit(1).alias("d"))), F.transform(held, lambda k: F.struct(k.alias("k"), F.lit(0).alias("d"))))
    rows = staged.select(F.explode(each).alias("x")).select(F.unhex("x.k").alias("key"), "x.d")
    return rows.groupBy("key").agg(F.sum("d").alias("docs"), F.sum(1 - F.col("d")).cast("long").alias("n"))


def strip_seen_lines(docs: DataFrame, batch: Column, batches: int, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Documents without the lines that at least ``least_docs`` documents of earlier batches held, and the lines that were removed.

    ``docs`` has ``doc_id`` and ``text``; ``batch`` numbers each row's batch from 0 below ``batches`` (null: 0). The first table has
    ``(doc_id, batch, text, n_all, n_removed)``, one row for each row of ``docs``: kept lines unchanged, joined by ``\\n``. The second has
    ``(key_sha256, batch, n_docs, n_removed)`` for every removed key: the first batch that removed it, all documents that held it, lines removed.

    A row is a document, also where rows repeat or share a doc_id or have none. A text is split at ``\\n``, trailing empty lines included; null and
    empty texts have one empty line. Keys of fewer than ``least_chars`` code points are never removed. What documents held originally counts, whether it was
    removed or not. Keys are told apart by their SHA-256. Other columns are ignored. An empty table gives two empty tables.
    """
    spark, folder = docs.sparkSession, _Folder(docs.sparkSession)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    cut_up = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", lines.alias("lines"), F.coalesce(batch.cast("int"), F.lit(0)).alias("batch"))
    keys = F.transform("lines", lambda x: F.when(F.length(line_key(x)) >= least_chars, F.sha2(line_key(x), 256)))
    staged = cut_up.select("row_no", "doc_id", "lines", keys.alias("keys"), "batch")
    staged.write.option("compression", "zstd").partitionBy("batch").parquet(folder("arriving"))
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    for at in (folder("arrived"), folder("counts"), folder("hits")):
        folder.make(at)
    incoming = spark.readStream.schema(schema).parquet(folder("arrived"))
    totals = incoming.select(F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k")).groupBy(F.unhex("k").alias("key")).agg(F.count("*").alias("total"))
    # a batch holds its share of the rows, so its shuffles and the state of its keys take their share of the partitions
    share = max(spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches))
    counted = "key binary, total long, earlier long, n long, batch int"

    for k in range(batches):
        folder.move(folder("arriving", f"batch={k}"), folder("arrived", f"batch={k}"))

        def settle(touched: DataFrame, _: int, k: int = k) -> None:
            # a key that enough earlier documents held has a larger total than that
            touched.where(F.col("total") > least_docs).write.mode("overwrite").parquet(folder("totals", k))
            mine = spark.read.schema(schema).parquet(folder("arrived")).where(F.col("batch") == k)
            known = spark.read.schema("key binary, total long").parquet(folder("totals", k))
            now = _increments(mine).join(known.hint("merge"), "key").select("key", "total", (F.col("total") - F.col("docs")).alias("earlier"), "n")
            now.write.mode("overwrite").parquet(folder("counts", f"batch={k}"))
            seen = spark.read.schema(counted).parquet(folder("counts")).where((F.col("batch") == k) & (F.col("earlier") >= least_docs)).select("key", "n")
            here = mine.select("row_no", F.posexplode("keys").alias("at", "k")).where("k is not null").select("row_no", "at", F.unhex("k").alias("key"))
            hits = split_join(here, seen, ["key"], "n", most=HOT_KEYS).groupBy("row_no").agg(F.collect_list("at").alias("gone"))
            hits.write.mode("overwrite").parquet(folder("hits", f"batch={k}"))

        with _settings(spark, STATE | {"spark.sql.shuffle.partitions": str(share)}):
            query = totals.writeStream.outputMode("update").foreachBatch(settle).option("checkpointLocation", folder("checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination()

    gone = spark.read.schema("row_no long, gone array<int>, batch int").parquet(folder("hits")).select("row_no", "gone")
    gone_at = F.coalesce("gone", F.array().cast("array<int>"))
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone_at)
    kept = F.array_join(F.transform(kept_at, lambda i: F.get("lines", i)), "\n")
    whole = spark.read.schema(schema).parquet(folder("arrived")).select("row_no", "doc_id", "batch", "lines")
    cleaned = whole.join(gone.hint("merge"), "row_no", "left").select("doc_id", "batch", kept.alias("text"), F.size("lines").cast("long").alias("n_all"), F.size(gone_at).cast("long").alias("n_removed"))
    removed = F.col("earlier") >= least_docs
    of_key = spark.read.schema(counted).parquet(folder("counts")).groupBy("key")
    lost = of_key.agg(F.min(F.when(removed, F.col("batch"))).alias("batch"), F.max("total").alias("n_docs"), F.sum(F.when(removed, F.col("n"))).alias("n_removed")).where("batch is not null")
    return cleaned, lost.select(F.lower(F.hex("key")).alias("key_sha256"), "batch", "n_docs", "n_removed")

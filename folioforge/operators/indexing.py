"""Building and refreshing the search index: chunks with vectors and metadata by collection, in versions of one table.

A document is chunked and embedded again only if its embedding signature (body, title, schema) changed; if only its metadata changed, stored vectors stay.
An update reads signatures alone, then only the buckets that hold a changed document, and writes only those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.rules import boost, collection_of, temporal_class
from folioforge.functions.text import canonical_json, text_hash, trigram_vector
from folioforge.operators.catalog import index_changes
from folioforge.operators.chunking import split_documents
from folioforge.sources.snapshots import Refused, Snapshot, SnapshotTable
from folioforge.storage import cut

#: Metadata of every chunk; all are strings but the last two.
FIELDS = (
    "content_hash", "title", "category", "source_url", "publisher", "publish_date", "document_type", "document_kind", "source_type", "source_section", "scope_unit", "policy_name", "topic_key", "admission_level", "validity_status",
    "effective_date", "valid_until", "parent_doc_id", "index_collection", "temporal_class", "series_key", "retention_status", "retention_reason", "canonical_doc_id",
)
NUMBERS = ("revision_year", "validity_confidence", "boost")
#: What a field says where the catalog has nothing.
MISSING = {"source_type": "unknown", "validity_status": "unknown_validity", "effective_date": "unknown", "valid_until": "unknown", "temporal_class": "undated", "retention_status": "archived"}
CHUNKS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("collection", "chunk_id", "doc_id", "heading", "text")]
    + [T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("embedding_sig", T.StringType()), T.StructField("metadata_sig", T.StringType())]
    + [T.StructField("metadata", T.StructType([T.StructField(n, T.StringType()) for n in FIELDS] + [T.StructField("revision_year", T.IntegerType()), T.StructField("validity_confidence", T.DoubleType()), T.StructField("boost", T.DoubleType())]))]
)
DOCUMENT = ["doc_id", "collection", "embedding_sig", "metadata_sig"]


@dataclass(frozen=True)
class Embedder:
    """A Column expression from text to a unit vector, with the name that an index is bound to."""

    model: str = "trigram-64"
    test_only: bool = True
    encode: Callable[[Column], Column] = field(default=trigram_vector, compare=False)


@dataclass(frozen=True)
class IndexReport:
    added: int
    updated: int
    deleted: int
    metadata_only: int
    skipped: int
    chunks: int
    buckets: int
    version: int


def indexable(catalog: DataFrame, schema_version: str = "2") -> DataFrame:
    """Documents that belong in a collection, with their metadata and signatures: ``doc_id, title, text, collection, metadata, embedding_sig, metadata_sig``.

    ``catalog`` has doc_id and text and any of the metadata fields; those it lacks are empty. Rows that are not accepted, have no file, no text or no
    collection are left out. Superseded and historical validity moves a document to the historical collection.
    """
    have = set(catalog.columns)
    get = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(MISSING.get(c, ""))) if c in have else F.lit(MISSING.get(c, ""))
    rows = catalog.where("coalesce(quality_status, 'accepted') = 'accepted'" if "quality_status" in have else "true").where("coalesce(file_path, '') <> ''" if "file_path" in have else "true").where("text is not null")
    retention = F.when(get("validity_status").isin("historical", "superseded"), "historical").otherwise(get("retention_status"))
    rows = rows.withColumn("collection", collection_of(get("document_kind"), retention)).where("collection is not null")
    own = {"retention_status": retention, "index_collection": F.col("collection"), "content_hash": text_hash(F.col("text")), "temporal_class": temporal_class(get("document_kind"))}
    metadata = {c: own.get(c, get(c)) for c in FIELDS}
    year = F.coalesce(F.col("revision_year").cast("int"), F.lit(0)) if "revision_year" in have else F.lit(0)
    sure = F.coalesce(F.col("validity_confidence").cast("double"), F.lit(0.0)) if "validity_confidence" in have else F.lit(0.0)
    metadata |= {"revision_year": year, "validity_confidence": sure, "boost": boost(get("document_kind"))}
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "collection", F.struct(*(c.alias(n) for n, c in metadata.items())).alias("metadata"))
    embedding = canonical_json({"content_hash": F.col("metadata.content_hash"), "title": F.col("metadata.title"), "schema_version": F.lit(schema_version)})
    every = canonical_json({n: F.col(f"metadata.{n}") for n in (*FIELDS, *NUMBERS)} | {"doc_id": F.col("doc_id")})
    return rows.select("doc_id", "text", "collection", "metadata", text_hash(embedding).alias("embedding_sig"), text_hash(every).alias("metadata_sig"))


def chunked(items: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks of :func:`indexable` rows with the vectors of their titled texts; a narrow stage."""
    item = F.col("item")  # rides along as the document of its chunks
    packed = items.select(F.struct("doc_id", "collection", "metadata", "embedding_sig", "metadata_sig").alias("doc_id"), "text")
    vector = embedder.encode(F.concat(item["metadata"]["title"], F.lit("\n"), F.col("text")))
    number = F.concat_ws(":", item["doc_id"], F.col("chunk_index").cast("string"))
    return split_documents(packed).withColumnRenamed("doc_id", "item").select(
        item["collection"].alias("collection"), number.alias("chunk_id"), item["doc_id"].alias("doc_id"), "heading", "text", vector.cast("array<double>").alias("vector"),
        item["embedding_sig"].alias("embedding_sig"), item["metadata_sig"].alias("metadata_sig"), item["metadata"].alias("metadata"),
    )


def problems(snapshot: Snapshot | None, embedder: Embedder, schema_version: str) -> list[str]:
    """Why an update may not build upon a version: another schema, another model, test vectors."""
    if snapshot is None:
        return []
    want = {"schema_version": schema_version, "embedding_model": embedder.model, "test_only": embedder.test_only}
    return [f"{k}: index {snapshot.meta.get(k)!r}, now {v!r}" for k, v in want.items() if snapshot.meta.get(k) != v]


def _meta(embedder: Embedder, schema_version: str, fingerprint: str) -> dict:
    return {"schema_version": schema_version, "embedding_model": embedder.model, "test_only": embedder.test_only, "fingerprint": fingerprint}


def content_fingerprint(documents: DataFrame) -> str:
    """One number for a set of (doc_id, collection, signatures), whatever the order and the partitions of its rows."""
    h = F.xxhash64(*DOCUMENT).cast("decimal(38,0)")
    n, a, b = documents.agg(F.count("*"), F.sum(h), F.bit_xor(F.xxhash64(*DOCUMENT[::-1]))).first()
    return f"{n}:{a or 0}:{b or 0}"


def _wrong(want_docs: int) -> Callable[[DataFrame], str | None]:
    def check(staged: DataFrame) -> str | None:
        rows, ids, docs, bare = staged.agg(F.count("*"), F.count_distinct("collection", "chunk_id"), F.count_distinct("doc_id"), F.count_if(F.col("vector").isNull())).first()
        if rows != ids:
            return f"{rows - ids} chunks share an id"
        return f"{bare} chunks have no vector" if bare else f"{docs} documents staged, {want_docs} wanted" if docs != want_docs else None

    return check


def build(table: SnapshotTable, items: DataFrame, embedder: Embedder, schema_version: str = "2", validate: Callable[[DataFrame], str | None] | None = None) -> IndexReport:
    """All documents anew, as the next version. Documents without any chunk count as skipped. ``validate`` may refuse the staged rows; then nothing changes."""
    items, base = cut(items, "items"), table.snapshot()
    with_text = items.where(F.regexp_replace("text", r"(?U)\s", "") != "")
    n, wanted = items.count(), with_text.count()
    check = _wrong(wanted)
    made = table.commit(chunked(with_text, embedder), base, _meta(embedder, schema_version, content_fingerprint(items)), None, lambda staged: check(staged) or (validate(staged) if validate else None))
    return IndexReport(n, 0, 0, 0, n - wanted, table.rows(made).count(), len(made.folders), made.version)


def update(table: SnapshotTable, items: DataFrame, embedder: Embedder, schema_version: str = "2", validate: Callable[[DataFrame], str | None] | None = None) -> IndexReport:
    """The next version from the newest one: only buckets of added, changed, moved and deleted documents are read and written.

    Refused if the base was built with another schema or model. Vectors of documents of which only metadata changed are kept. A document that changed its collection counts as updated. Without any
    change the newest version stays.
    """
    base = table.snapshot()
    if wrong := problems(base, embedder, schema_version):
        raise Refused("; ".join(wrong))
    items = cut(items, "items")
    wanted = cut(items.where(F.regexp_replace("text", r"(?U)\s", "") != ""), "wanted")
    # a move between collections changes the embedding side, so that the chunks are written anew
    placed = lambda d: d.select("doc_id", F.concat_ws("|", "collection", "embedding_sig").alias("e"), "metadata_sig")
    stored = table.rows(base).select(*DOCUMENT).distinct()
    changes = cut(index_changes(placed(stored), placed(wanted)).withColumn("bucket", table.bucket()), "changes")
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    touched = {r["bucket"] for r in changes.where("change <> 'unchanged'").select("bucket").distinct().collect()}
    skipped = items.count() - wanted.count()
    version = base.version if base else 0
    if touched or base is None:
        old = table.rows(base, touched)
        same = old.join(changes.where("change = 'unchanged'").select("doc_id"), "doc_id", "left_semi")
        fresh = wanted.select("doc_id", F.col("metadata").alias("m"), F.col("metadata_sig").alias("s")).join(changes.where("change = 'metadata_only'").select("doc_id"), "doc_id", "left_semi")
        relabelled = old.join(fresh, "doc_id").withColumn("metadata", F.col("m")).withColumn("metadata_sig", F.col("s")).select(*CHUNKS.names)
        anew = chunked(wanted.join(changes.where("change in ('added', 'updated')").select("doc_id"), "doc_id", "left_semi"), embedder)
        live = changes.where(F.col("change") != "deleted")
        check = _wrong(live.where(F.col("bucket").isin(*touched)).count() if touched else 0)
        rows = same.select(*CHUNKS.names).unionByName(relabelled).unionByName(anew.select(*CHUNKS.names))
        made = table.commit(rows, base, _meta(embedder, schema_version, content_fingerprint(items)), touched, lambda staged: check(staged) or (validate(staged) if validate else None))
        base, version = made, made.version
    n = lambda k: counts.get(k, 0)
    return IndexReport(n("added"), n("updated"), n("deleted"), n("metadata_only"), skipped, table.rows(base).count(), len(touched), version)


def split_collection(chunks: DataFrame, kinds: DataFrame) -> DataFrame:
    """Chunks of one old collection with the collection that their document's kind asks for; ``kinds``: doc_id, document_kind, retention.

    Chunks of unknown documents and of kinds without a collection have a null ``target`` and stay where they are.
    """
    target = collection_of(F.col("document_kind"), F.col("retention"))
    return chunks.join(kinds, "doc_id", "left").withColumn("target", F.when(F.col("document_kind").isNotNull(), target)).drop("document_kind", "retention")


def rebuilt_corpus(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``rows`` with the ``keep`` of an audit's ``decisions (doc_id, keep)``: refused unless both hold the same ids once each."""
    both = rows.select("doc_id", F.lit(1).alias("a")).join(decisions.select("doc_id", F.lit(1).alias("b")), "doc_id", "full")
    off = both.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("a").alias("na"), F.count("b").alias("nb")).where("n > 1 or na = 0 or nb = 0").limit(1).count()
    if off:
        raise Refused("the audit does not cover the same documents")
    return rows.join(decisions.where("keep").select("doc_id"), "doc_id", "left_semi")

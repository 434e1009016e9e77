"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes decides, at every character start, whether a chunk may end;
the cut then moves to the next word start if one is near. Cuts depend on nearby bytes alone, so
an insertion changes the chunks around it and leaves all others. A chunk whose digest occurred earlier
(in order of doc_id, text hash and position) is a repeat; runs of repeats of at least ``min_words`` words are removed.

Passes over the texts: one counts 64-bit chunk hashes, which Spark adds up; hashes counted twice go into
a bitmap of bounded size; the second pass gives 128-bit digests of chunks in the bitmap, so only these
move; the third removes runs. The bitmap filters work only: digests decide. Beyond some tens of millions of
repeated hashes the bitmap lets more chunks through, at most all: 16 bytes of digest and 20 of place for each.

A row is known by its doc_id and the 64-bit hash of its text, so rows that share a doc_id are told apart.
A digest that very many chunks share is joined where its rows lie and never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.llm import bloom
from folioforge.llm.arrays import IS_CONT, SpanHasher, row_of, text_slices, words
from folioforge.llm.skew import split_join
from folioforge.storage import cut

#: A cut at one character start in 32 on average; chunks of 16 to 512 bytes away from text ends.
MASK, LEAST, MOST, SNAP = np.uint16(0xF800), 16, 512, 24
#: A removed run has at least so many words.
MIN_WORDS = 20
BITMAP_BITS = 1 << 27
GEAR = np.random.default_rng(424242).integers(0, 2**16, 256).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: h = 2 h + GEAR[byte], which forgets all but 16 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[k:] = h[:-k] if k < len(h) else 0
        h = h + (older << np.uint16(k))
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks, and the first chunk of each row. Chunks of a row cover it; an empty row has none."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = gear(data)
    at = np.flatnonzero((h[:-1] & MASK) == 0) + 1  # a cut stands before byte `at`
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[(at - offsets[row] >= 16) & ~IS_CONT[data[at]]]  # the hash window lies inside the row
    starts, _, _ = words(data, offsets)
    near = np.searchsorted(starts, at)
    snap = starts[np.minimum(near, len(starts) - 1)] if len(starts) else at
    limit = offsets[np.searchsorted(offsets, at, "right")]
    at = np.where((snap >= at) & (snap - at <= SNAP) & (snap < limit), snap, at)
    at = np.unique(at)
    if len(at):  # a cut goes if another stands less than LEAST before it: a rule on nearby bytes only
        at = at[np.concatenate([[True], np.diff(at) >= LEAST])]
    begin = np.unique(np.concatenate([at, offsets[:-1][np.diff(offsets) > 0]]))
    size = np.diff(np.append(begin, n))
    for i in np.flatnonzero(size > MOST):  # long stretches without a cut are cut evenly, at character starts
        more = np.arange(begin[i] + MOST, begin[i] + size[i], MOST)
        while IS_CONT[data[more]].any():
            more = more - IS_CONT[data[more]]
        begin = np.append(begin, more)
    begin = np.unique(begin)
    return begin, np.searchsorted(begin, offsets)


def _ends(begin: np.ndarray, total: int) -> np.ndarray:
    return np.append(begin[1:], total).astype(np.int64) if len(begin) else begin


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for _, _, data, off in text_slices(batch):
            begin, _ = chunks(data, off)
            key, n = np.unique(SpanHasher(data).spans(begin, _ends(begin, len(data))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def _digests(wanted):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, data, off in text_slices(batch):
                begin, first = chunks(data, off)
                end, row = _ends(begin, len(data)), row_of(first)
                hit = np.flatnonzero(bloom.might_contain(wanted.value, SpanHasher(data).spans(begin, end).view(np.int64)))
                raw = data.tobytes()
                dig = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin[hit].tolist(), end[hit].tolist(), strict=True)]
                ids = [batch.column(c).slice(lo, hi - lo).take(pa.array(row[hit])) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array((hit - first[row[hit]]).astype(np.int32)), pa.array(dig, pa.binary())], names=["doc_id", "key", "idx", "digest"])

    return run


def _remove(min_words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            repeats = batch.column(2)
            given_null = batch.column(1).is_null().to_pylist()
            for lo, hi, data, off in text_slices(batch):
                begin, first = chunks(data, off)
                end = _ends(begin, len(data))
                wstart, _, _ = words(data, off)
                n_words = np.diff(np.searchsorted(wstart, np.append(begin, len(data))))
                rows = {c: [] for c in ("text", "n_chunks", "n_repeats", "removed_chars", "spans", "first_doc_ids")}
                raw = data.tobytes()
                for i, rep in enumerate(repeats.slice(lo, hi - lo).to_pylist()):
                    a, b = int(first[i]), int(first[i + 1])
                    at = np.array([r["idx"] for r in rep or []], np.int64)
                    kept, spans, sources, pos, gone = [], [], set(), int(off[i]), 0
                    if len(at):
                        edge = np.flatnonzero(np.diff(at) != 1) + 1
                        for run_ in np.split(np.arange(len(at)), edge):
                            x, y = a + int(at[run_[0]]), a + int(at[run_[-1]]) + 1
                            if n_words[x:y].sum() >= min_words:
                                kept.append(raw[pos : begin[x]])
                                spans.append((int(begin[x]), int(end[y - 1])))
                                sources.update(rep[k]["first_doc"] for k in run_)
                                gone += y - x
                                pos = int(end[y - 1])
                    if spans:
                        kept.append(raw[pos : off[i + 1]])
                        prefix = lambda p: len(raw[off[i] : p].decode("utf-8", "replace"))  # noqa: B023, E731
                        spans = [{"start": prefix(p), "stop": prefix(q)} for p, q in spans]
                    text = b"".join(kept).decode("utf-8", "replace") if spans else raw[off[i] : off[i + 1]].decode("utf-8", "replace")
                    rows["text"].append(None if given_null[lo + i] else text)
                    rows["n_chunks"].append(b - a)
                    rows["n_repeats"].append(gone)
                    rows["removed_chars"].append(sum(s["stop"] - s["start"] for s in spans))
                    rows["spans"].append(spans)
                    rows["first_doc_ids"].append(sorted(sources))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.int64()))
                given = [batch.column(c).slice(lo, hi - lo) for c in (0, 3)]
                yield pa.RecordBatch.from_arrays([given[0], *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)), given[1]], names=["doc_id", *rows, "kept"])

    return run


OUT = "doc_id long, text string, n_chunks long, n_repeats long, removed_chars long, spans array<struct<start: long, stop: long>>, first_doc_ids array<long>"


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, bitmap_bits: int = BITMAP_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: its text without repeated passages, counts of its chunks and of the removed ones, removed
    character spans and the doc_ids where removed chunks were first seen; then the columns ``keep`` of the input as they are.

    The earliest copy in order of (doc_id, hash of the text, position) stays, also within one document. Null texts stay
    null, empty ones empty. Rows with a null doc_id stay unchanged and are no source. Rows that share a doc_id are documents of their
    own if their texts differ; rows equal in both are one document and get one answer. Whole copies of an earlier
    document become empty. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key"),
        F.struct(F.lit(0).alias("none_"), *keep).alias("kept"),
    )
    named = docs.where("doc_id is not null and length(text) > 0").select("doc_id", "key", "text")
    counted = named.select("text").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    wanted = spark.sparkContext.broadcast(bloom.build(counted.where("n > 1"), "key", bitmap_bits))
    seen = cut(named.mapInArrow(_digests(wanted), "doc_id long, key long, idx int, digest binary"), "chunks")
    place = F.struct("doc_id", "key", "idx")
    first = cut(seen.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    repeats = split_join(seen, first, ["digest"], "n").where(place != F.col("first")).select("doc_id", "key", "idx", F.col("first.doc_id").alias("first_doc")).distinct()
    repeats = repeats.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("idx", "first_doc"))).alias("repeats"))
    both = docs.join(repeats, ["doc_id", "key"], "left").select("doc_id", "text", "repeats", "kept")
    out = StructType([*StructType.fromDDL(OUT).fields, both.schema["kept"]])
    done = both.mapInArrow(_remove(min_words), out)
    return done.select(*StructType.fromDDL(OUT).names, *(F.col("kept")[c].alias(c) for c in keep))

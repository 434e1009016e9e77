"""Product codes of vectors in whole numbers, found by partial-distance search.

A component x becomes floor(256 x); a vector is cut into equal consecutive parts, and every part position has a codebook
that starts from the vectors of the least ids and is refined by rounds of assignment and floored means. All numbers are
integers, so the result does not depend on how Spark deals the rows.

Search: dimensions are taken in descending variance of the codebook. The entry nearest in the first of them gives a first complete
distance; entries then come in blocks, and a (vector, entry) pair is dropped as soon as its accumulated distance strictly exceeds
the least complete distance so far. Equal distances stay, so ties go to the lower index.

Codebooks (``parts`` x ``entries`` short vectors) are all that is broadcast or reaches the driver; tasks add up their own rows before
sums are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioforge.llm.skew import split_join
from folioforge.storage import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are held within +-``BOUND`` before scaling, so that sums of squares fit 64 bits.
BOUND = float(1 << 16)
BLOCK = 16
_FAR = np.iinfo(np.int64).max


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry for each row, exact, ties to the lower index."""
    rows, dims = x.shape
    if not dims:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    spread = len(book) * (book * book).sum(axis=0) - book.sum(axis=0) ** 2
    dim_order = np.argsort(-spread, kind="stable")
    lead = dim_order[0]
    by_lead = np.argsort(book[:, lead], kind="stable")
    sorted_lead = book[by_lead, lead]
    at = np.minimum(np.searchsorted(sorted_lead, x[:, lead]), len(book) - 1)
    below = np.maximum(at - 1, 0)
    at = np.where(np.abs(sorted_lead[below] - x[:, lead]) <= np.abs(sorted_lead[at] - x[:, lead]), below, at)
    index = by_lead[at]
    best = ((x - book[index]) ** 2).sum(axis=1)
    for lo in range(0, len(book), BLOCK):
        part = book[lo : lo + BLOCK]
        so_far = (x[:, lead, None] - part[None, :, lead]) ** 2
        row, col = np.nonzero(so_far <= best[:, None])
        dist = so_far[row, col]
        for j in dim_order[1:]:
            dist = dist + (x[row, j] - part[col, j]) ** 2
            live = dist <= best[row]
            row, col, dist = row[live], col[live], dist[live]
        done = np.full((rows, len(part)), _FAR)
        done[row, col] = dist
        first = done.argmin(axis=1)
        least = done[np.arange(rows), first]
        better = (least < best) | ((least == best) & (first + lo < index))
        index, best = np.where(better, first + lo, index), np.where(better, least, best)
    return index, best


def _numbers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows of ``width`` integers; shorter ones end in zeros."""
    lists = batch.column(batch.schema.get_field_index("numbers"))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _refined(numbers: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, dims = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _numbers(batch, parts * dims).reshape(-1, parts, dims)
            for p in range(parts):
                index, _ = nearest(x[:, p], books[p])
                np.add.at(total[p], index, x[:, p])
                count[p] += np.bincount(index, minlength=entries)
        used = np.argwhere(count > 0)
        slot = np.repeat(used[:, 0] * entries + used[:, 1], dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(np.tile(np.arange(dims), len(used))), pa.array(total[count > 0].reshape(-1)), pa.array(np.repeat(count[count > 0], dims))], names=["slot", "at", "total", "n"]
        )

    sums = numbers.select("numbers").mapInArrow(add_up, "slot long, at long, total long, n long").groupBy("slot", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = books.reshape(parts * entries, dims).copy()
    if sums.num_rows:
        slot, at, total, n = (sums[c].to_numpy() for c in ("slot", "at", "total", "n"))
        out[slot, at] = total // n
    return out.reshape(books.shape)


def fit(numbers: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x dimensions) of a written table ``(vec_id, numbers)``."""
    first = numbers.where("vec_id is not null").orderBy("vec_id", "numbers").limit(entries).select("numbers").toArrow()
    start = np.zeros((0, width), np.int64)
    if first.num_rows:
        start = np.concatenate([_numbers(b, width) for b in first.combine_chunks().to_batches()])
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        books = _refined(numbers, books)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(numbers: DataFrame, books: np.ndarray) -> DataFrame:
    """``(vec_id, label, code, error)``: two hex digits of the nearest entry for each part, and the squared distances summed."""
    parts, _, dims = books.shape
    fields = [numbers.schema["vec_id"], numbers.schema["label"], StructField("code", StringType()), StructField("error", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch, parts * dims).reshape(-1, parts, dims)
            index, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                index[:, p], d = nearest(x[:, p], books[p])
                error += d
            digits = index.tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return numbers.select("vec_id", "label", "numbers").mapInArrow(run, StructType(fields))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` for every usable row of ``(vec_id, embedding, label)``.

    Rows whose vector is null or holds null, NaN or infinite components are dropped. Repeated rows count and come out each by
    itself; of equal vec_ids the lesser vector starts a codebook first, null vec_ids start none. Fewer rows than ``entries`` give fewer
    entries. Vectors shorter than the longest, or than the next multiple of ``parts``, count as ending in zeros. Components beyond
    +-``BOUND`` count as the bound. Null labels are one label of their own, whatever the label's type. Other columns are ignored; an empty
    table gives no rows.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v, F.lit(-BOUND)), F.lit(BOUND)) * SCALE).cast("long"))
    numbers = cut(vectors.where(usable).select("vec_id", "label", whole.alias("numbers")), "numbers")
    longest = numbers.agg(F.coalesce(F.max(F.size("numbers")), F.lit(0))).first()[0]
    books = fit(numbers, -(-longest // parts) * parts, parts, entries, rounds)
    label = F.coalesce(F.col("label").cast("string"), F.lit(""))
    coded = cut(encode(numbers, books).withColumn("of_label", F.concat(F.when(F.col("label").isNull(), "-").otherwise("+"), label)), "codes")
    sums = cut(coded.groupBy("of_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    return split_join(coded, sums, ["of_label"], "n").select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))

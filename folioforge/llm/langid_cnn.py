"""Language identification by a byte convolutional network, trained and applied in numpy.

Texts are cut into windows of ``WINDOW`` bytes (the last one padded with byte 0). Bytes are embedded; filters of
widths 2, 3 and 4 run over them; each filter keeps its maximum; a softmax layer gives class
probabilities. A document's probabilities are the softmax of the mean log probabilities of its windows.
Applying the network uses tables of byte-pair responses, which are the same sums in another order.

Bounds: the fit learns every language, from at most ``FIT_DOCS`` rows of each (fewer if there are so many that ``FIT_ROWS`` would be passed), those of the
smallest hash of doc_id and text, and of each at most ``FIT_WINDOWS`` windows spread evenly over the whole text. Prediction
covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.arrays import row_of, row_sums, text_slices

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 8, 8
FIT_ROWS, FIT_DOCS, FIT_WINDOWS, EPOCHS, BATCH, SEED = 80_000, 400, 6, 12, 64, 11


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (rows x WINDOW bytes) and the first window of each text; an empty text has one of padding."""
    size = np.diff(offsets)
    per = np.maximum(1, -(-size // WINDOW))
    first = np.concatenate([[0], np.cumsum(per)])
    row = row_of(first)
    begin = offsets[row] + (np.arange(first[-1]) - first[row]) * WINDOW
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < offsets[row + 1][:, None]
    if not len(data):
        return np.zeros((int(first[-1]), WINDOW), np.uint8), first
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), first


@dataclass
class ByteConvNet:
    """Embedding, one filter bank for each width, and the softmax layer."""

    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    banks: dict[int, np.ndarray]  # width -> width x EMBED x FILTERS
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_b: np.ndarray

    def _tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width, (offset, response table) of byte pairs or, for a last odd byte, of bytes."""
        if not hasattr(self, "_held"):
            self._held = {}
            for w in WIDTHS:
                single = [(self.embed @ self.banks[w][k]).astype(np.float32) for k in range(w)]
                parts = [(k, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1)) for k in range(0, w - 1, 2)]
                self._held[w] = parts + ([(w - 1, single[w - 1])] if w % 2 else [])
        return self._held

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Maxima of all filters over each window."""
        x = x.astype(np.int64)
        pair = x[:, :-1] * 256 + x[:, 1:]
        out = []
        for w in WIDTHS:
            n, total = WINDOW - w + 1, None
            for k, table in self._tables()[w]:
                part = np.take(table, (x if len(table) == 256 else pair)[:, k : k + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            out.append(np.maximum(total.max(axis=1) + self.bias[w], 0))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for lo in range(0, len(x), 128):
            y = self.pooled(x[lo : lo + 128]) @ self.out + self.out_b
            y = y - y.max(axis=1, keepdims=True)
            parts.append(y - np.log(np.exp(y).sum(axis=1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)))

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Class probabilities of each text."""
        x, first = windows(data, offsets)
        logp = self.log_probabilities(x)
        mean = np.stack([row_sums(logp[:, k], first) for k in range(logp.shape[1])], axis=1) / np.diff(first)[:, None]
        e = np.exp(mean - mean.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str]) -> ByteConvNet:
    """Adam on the cross-entropy of windows; the order of minibatches is fixed by ``SEED``."""
    rng = np.random.default_rng(SEED)
    p = {"embed": rng.normal(size=(256, EMBED)) * 0.3, "out": rng.normal(size=(len(WIDTHS) * FILTERS, len(langs))) * 0.2, "out_b": np.zeros(len(langs))}
    for w in WIDTHS:
        p[f"k{w}"], p[f"b{w}"] = rng.normal(size=(w, EMBED, FILTERS)) / np.sqrt(w * EMBED), np.zeros(FILTERS)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = np.sqrt(len(y) / (len(langs) * np.maximum(np.bincount(y, minlength=len(langs)), 1)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            i = order[lo : lo + BATCH]
            xb, yb = x[i].astype(np.int64), y[i]
            e = p["embed"][xb]
            pooled, where = [], {}
            for w in WIDTHS:
                n = WINDOW - w + 1
                s = sum(e[:, k : k + n] @ p[f"k{w}"][k] for k in range(w))
                where[w] = s.argmax(axis=1)
                pooled.append(np.take_along_axis(s, where[w][:, None], axis=1)[:, 0] + p[f"b{w}"])
            h = np.maximum(np.concatenate(pooled, axis=1), 0)
            z = h @ p["out"] + p["out_b"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(i)), yb] -= 1
            q *= (weight[yb] / len(i))[:, None]
            g = {"out": h.T @ q, "out_b": q.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            gh = (q @ p["out"].T) * (h > 0)
            for j, w in enumerate(WIDTHS):
                gp = gh[:, j * FILTERS : (j + 1) * FILTERS]
                g[f"b{w}"], g[f"k{w}"] = gp.sum(axis=0), np.zeros_like(p[f"k{w}"])
                rows = np.arange(len(i))[:, None]
                for k in range(w):
                    byte = xb[rows, where[w] + k]
                    g[f"k{w}"][k] = np.einsum("bfe,bf->ef", p["embed"][byte], gp)
                    np.add.at(g["embed"], byte, gp[:, :, None] * p[f"k{w}"][k].T[None])
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return ByteConvNet(langs, p["embed"], {w: p[f"k{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["out"], p["out_b"])


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lo, hi, data, off in text_slices(batch):
            x, first = windows(data, off)
            parts = []
            for a, n in zip(first[:-1].tolist(), np.diff(first).tolist(), strict=True):
                parts.append(x[a + np.unique(np.arange(FIT_WINDOWS) * n // FIT_WINDOWS)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(parts, pa.binary())], names=["row", "lang", "bytes"])


def train(docs: DataFrame) -> ByteConvNet | None:
    """The network fitted to ``doc_id, text, lang``. Rows with null text, lang or doc_id teach nothing; None if no row is left.

    Rows equal in doc_id, text and lang count once. Which rows are taken is told by a bar on their hash for each language, set
    from its number of distinct rows to let half as many again through; a task then ranks the few that passed. So no
    language is gathered in one task. Every language has the same number of rows at most: ``FIT_DOCS``, or its share of ``FIT_ROWS``, or one. So at
    most ``FIT_ROWS`` x ``FIT_WINDOWS`` windows come to the driver (62 MB) unless there are more languages than that.
    """
    known = docs.where("text is not null and lang is not null and doc_id is not null and length(text) > 0")
    known = known.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("row", 0.05).alias("n")).collect()
    if not sizes:
        return None
    each = min(FIT_DOCS, max(1, FIT_ROWS // len(sizes)))
    place = F.shiftrightunsigned("row", 1) / float(1 << 63)
    bars = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.5 * each + 8) / max(r["n"], 1))) for r in sizes], "lang string, bar double")
    passed = known.join(F.broadcast(bars), "lang").where(place <= F.col("bar")).select("row", "text", "lang")
    few = passed.mapInArrow(_cut, "row long, lang string, bytes binary").groupBy("lang", "row").agg(F.first("bytes").alias("bytes"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("row"))
    got = few.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "bytes").toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got["lang"].to_pylist(), got["bytes"].to_pylist(), strict=True))
    langs = sorted({x for x, _ in rows})
    at = {x: i for i, x in enumerate(langs)}
    label = np.repeat([at[x] for x, _ in rows], [len(b) // WINDOW for _, b in rows])
    return fit(np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(-1, WINDOW), label, langs)


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, in one narrow stage.

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a network.
    Repeated rows are predicted each; other columns are ignored; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = held.value
        for batch in it:
            letter = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_slices(batch):
                p = n.documents(data, off) if n else np.zeros((hi - lo, 1))
                ok = letter[lo:hi] if n else np.zeros(hi - lo, bool)
                best = p.argmax(axis=1)
                lang = [n.langs[k] if g else "und" for k, g in zip(best.tolist(), ok.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang), pa.array(np.where(ok, p[np.arange(len(p)), best], 0.0))], names=["doc_id", "lang_pred", "score"])

    has = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), has).mapInArrow(run, "doc_id long, lang_pred string, score double")

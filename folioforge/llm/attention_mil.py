"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is described by its byte-class bigram
frequencies and a few repetition and shape rates, encoded by a learned layer; gated attention
(tanh branch times sigmoid branch) weights the encodings, and the weighted sum is scored. Only document
labels train it; encoder, gates and scorer are fitted together by Adam in numpy.

Bounds: the fit takes at most ``FIT_DOCS`` labelled rows, the ones with the smallest hash of doc_id and text, and of each at
most ``FIT_PASSAGES`` passages spread evenly over the whole text; scoring covers every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.llm.arrays import IS_SPACE, SpanHasher, row_of, text_slices, window_hashes, words

PASSAGE, FIT_DOCS, FIT_PASSAGES = 64, 4000, 64
WIDTH, GATE, EPOCHS, BATCH, SEED = 24, 12, 30, 64, 5
_CLASSES = 14


def _classes() -> np.ndarray:
    t = np.full(256, 13, np.int64)
    t[:128] = 12
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[IS_SPACE], t[10] = 3, 4
    for k, group in enumerate((b".", b",", b"!?", b"|", b"#*$%&", b"<>{}[]()", b"-_/:;@")):
        t[list(group)] = 5 + k
    return t


CLASS = _classes()
FEATURES = _CLASSES**2 + 5


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the first passage of each row. Every row has at least one passage."""
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    per = np.maximum(1, -(-n // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(per)])
    total = int(begin[-1])
    wrow = row_of(first)
    wp = begin[wrow] + (np.arange(len(starts)) - first[wrow]) // PASSAGE  # passage of each word
    # a byte belongs to the passage of the last word that began at or before it, or its row's first
    brow = row_of(offsets)
    at = np.searchsorted(starts, np.arange(len(data)), "right") - 1
    bp = np.where(at >= first[brow], wp[np.maximum(at, 0)] if len(wp) else 0, begin[brow])
    cls = CLASS[data]
    pair = cls[:-1] * _CLASSES + cls[1:]
    same = bp[:-1] == bp[1:] if len(bp) else np.zeros(0, bool)
    x = np.bincount(bp[:-1][same] * _CLASSES**2 + pair[same], minlength=total * _CLASSES**2).reshape(total, -1).astype(np.float32)
    x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
    h = SpanHasher(data).spans(starts, ends)
    rates = np.zeros((total, 5), np.float32)
    count = np.maximum(np.bincount(wp, minlength=total), 1)
    rates[:, 0] = np.minimum(np.bincount(wp, minlength=total) / PASSAGE, 1)
    rates[:, 1] = np.bincount(wp, ends - starts, total) / count / 10
    for col, width in ((2, 1), (3, 3)):  # share of words / 3-word windows that occurred earlier in the row
        g, b = (h, first) if width == 1 else window_hashes(h, first, width)
        r = row_of(b)
        order = np.lexsort((np.arange(len(g)), g, r))
        seen = np.zeros(len(g), bool)
        seen[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (r[order[1:]] == r[order[:-1]])
        gp = begin[r] + (np.arange(len(g)) - b[r]) // PASSAGE
        rates[:, col] = np.bincount(gp, seen, total) / np.maximum(np.bincount(gp, minlength=total), 1)
    rates[:, 4] = row_of(begin) * 0 + np.repeat(np.log1p(n) / 10, per)
    return np.concatenate([x, rates], axis=1), begin


@dataclass
class Attention:
    """Weights of the fitted network and the standardisation of its inputs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * s) @ w["a"]
        row = row_of(first)
        top = np.maximum.reduceat(e, first[:-1])
        k = np.exp(e - top[row])
        att = k / np.add.reduceat(k, first[:-1])[row]
        z = np.add.reduceat(att[:, None] * h, first[:-1], axis=0)
        y = z @ w["c"] + w["c_b"]
        return {"x": x, "h": h, "t": t, "s": s, "row": row, "att": att, "z": z, "p": 1 / (1 + np.exp(-np.clip(y, -40, 40)))}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["p"]


def gradients(net: Attention, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted cross-entropy, sum of weight x loss, by all weights of the network."""
    w, o = net.weights, net.forward(x, first)
    gy = (o["p"] - label) * weight
    gz = gy[:, None] * w["c"]
    ga = (gz[o["row"]] * o["h"]).sum(axis=1)
    ge = o["att"] * (ga - np.add.reduceat(o["att"] * ga, first[:-1])[o["row"]])
    gt, gs = ge[:, None] * w["a"] * o["s"] * (1 - o["t"] ** 2), ge[:, None] * w["a"] * o["t"] * o["s"] * (1 - o["s"])
    gh = (o["att"][:, None] * gz[o["row"]] + gt @ w["v"].T + gs @ w["u"].T) * (1 - o["h"] ** 2)
    return {"c": o["z"].T @ gy, "c_b": np.array([gy.sum()]), "a": (o["t"] * o["s"]).T @ ge, "v": o["h"].T @ gt, "u": o["h"].T @ gs, "enc": o["x"].T @ gh, "enc_b": gh.sum(axis=0)}


def start(x: np.ndarray) -> Attention:
    """The network before training; ``SEED`` fixes it."""
    rng = np.random.default_rng(SEED)
    shape = {"enc": (x.shape[1], WIDTH), "enc_b": (WIDTH,), "v": (WIDTH, GATE), "u": (WIDTH, GATE), "a": (GATE,), "c": (WIDTH,), "c_b": (1,)}
    w = {k: (rng.normal(size=s) / np.sqrt(s[0]) if not k.endswith("_b") else np.zeros(s)) for k, s in shape.items()}
    return Attention(x.mean(axis=0), x.std(axis=0) + 1e-2, w)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray) -> Attention:
    """Adam on class-balanced cross-entropy, over minibatches of whole documents. The order is fixed by ``SEED``."""
    net, rng = start(x), np.random.default_rng(SEED + 1)
    w = net.weights
    share = np.clip(np.array([(label == 0).mean(), (label == 1).mean()]), 1e-3, 1)
    weight = np.sqrt(0.5 / share)[label]
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            docs = np.sort(order[lo : lo + BATCH])
            n = (first[1:] - first[:-1])[docs]
            f = np.concatenate([[0], np.cumsum(n)])
            rows = np.arange(f[-1]) + np.repeat(first[docs] - f[:-1], n)
            g = gradients(net, x[rows], f, label[docs], weight[docs] / len(docs))
            step += 1
            for k in w:
                d = g[k] + 1e-4 * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d**2
                w[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lo, hi, data, off in text_slices(batch):
            x, first = passages(data, off)
            parts = []
            for a, n in zip(first[:-1].tolist(), np.diff(first).tolist(), strict=True):
                take = a + np.unique(np.arange(min(n, FIT_PASSAGES)) * n // min(n, FIT_PASSAGES))
                parts.append(x[take].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(parts, pa.binary())], names=["row", "bag"])


def train(docs: DataFrame, labels: DataFrame) -> Attention | None:
    """The network fitted to ``labels`` (doc_id, label 0 or 1); None without labelled documents of both classes.

    Rows of ``labels`` with another or a null label are ignored; a doc_id labelled twice counts with its smallest label. Rows
    of ``docs`` that share a doc_id have its label each; rows equal in doc_id and text count once. At most ``FIT_DOCS`` bags
    of ``FIT_PASSAGES`` passages come to the driver (104 MB).
    """
    known = labels.where(F.col("label").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").cast("int").alias("label"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    chosen = docs.select("doc_id", "row").join(known, "doc_id").groupBy("row").agg(F.min("label").alias("label")).orderBy("row").limit(FIT_DOCS)
    label = {r[0]: r[1] for r in chosen.collect()}
    if len(set(label.values())) < 2:
        return None
    rows = docs.join(F.broadcast(docs.sparkSession.createDataFrame([(r,) for r in label], "row long")), "row").select("row", "text")
    got = rows.mapInArrow(_encode, "row long, bag binary").groupBy("row").agg(F.first("bag").alias("bag")).toArrow().sort_by("row")  # the same fit whatever the order of rows
    bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for b in got["bag"].to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return fit(np.concatenate(bags), first, np.array([label[r] for r in got["row"].to_pylist()], np.int64))


def score(docs: DataFrame, net: Attention | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score`` for every row, the estimated probability of label 1, then the columns ``keep`` of the input. One narrow stage.

    Null and empty texts are one passage without words. Without a network every score is 0.5.
    Repeated rows are scored each; other columns are ignored; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    others = [c for c in keep if c not in ("doc_id", "score", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("none_"), *others).alias("kept"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, data, off in text_slices(batch):
                y = np.full(hi - lo, 0.5) if held.value is None else held.value.scores(*passages(data, off))
                row = batch.slice(lo, hi - lo)
                given = [row.column(1)] if "text" in keep else []
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array(y.astype(np.float64)), *given, row.column(2)], names=["doc_id", "score", *(["text"] if given else []), "kept"])

    text = ", text string" if "text" in keep else ""
    out = StructType([*StructType.fromDDL(f"doc_id long, score double{text}").fields, rows.schema["kept"]])
    return rows.mapInArrow(run, out).select("doc_id", "score", *(["text"] if text else []), *(F.col("kept")[c].alias(c) for c in others))

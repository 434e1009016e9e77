"""Words of scripts without spaces: a dictionary counted from the corpus, and most likely cuts of runs.

Spark counts all character sequences of up to ``longest`` + 1 characters inside runs of the script. A sequence is a word if it is frequent,
holds together (its probability exceeds that of every pair of parts by far) and is free at both ends (the entropy of its
neighbours; the ends of runs are neighbours too). The dictionary is kept as sorted 64-bit hashes beside log probabilities and is bounded by
``most`` entries, the most frequent ones, so it may be broadcast. A run is cut where the sum of log probabilities is largest; single characters outside the dictionary cost
``UNKNOWN`` times the rarest count. All runs of about ``SLICE`` characters of whole texts are counted or cut in step, in numpy, so a task's
memory is bounded by that or by its longest text, whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.storage import cut

#: Code points of ideographs, and of the letters of the given tables.
CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
LATIN = ((0x61, 0x7A), (0xDF, 0xF6), (0xF8, 0x24F))
EDGE = 0x5E
LONGEST, LEAST, COHESION, ENTROPY, MOST = 4, 5, 1.0, 1.0, 1 << 20
UNKNOWN = 0.5
#: Cells of a table of best cuts, so many at once.
CELLS = 1 << 22
#: Characters of whole texts that are worked on at once.
SLICE = 1 << 19
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Whole texts of about ``SLICE`` characters together, and the row of the first; null texts are empty."""
    texts = pc.fill_null(texts, "")
    end = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] + SLICE, "right")) - 1)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins; null texts are empty."""
    rows = ["" if t is None else t for t in texts.to_pylist()]
    data = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in rows])]).astype(np.int64)


def runs(codes: np.ndarray, offsets: np.ndarray, ranges: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of the script; a run does not pass the end of its text."""
    inside = np.zeros(len(codes), bool)
    for lo, hi in ranges:
        inside |= (codes >= lo) & (codes <= hi)
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` codes from each place on."""
    if len(codes) < n:
        return np.zeros(0, _U)
    h = np.full(len(codes) - n + 1, n, _U)
    for k in range(n):
        h = _mixed(h * _U(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k].astype(_U))
    return h


def _counted(longest: int, ranges: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (part for batch in batches for _, part in _slices(batch.column(0))):
            codes, offsets = _codes(texts)
            starts, ends = runs(codes, offsets, ranges)
            size = ends - starts
            seq = np.full(int(size.sum()) + len(size) + 1, EDGE, np.uint32)
            at = np.arange(int(size.sum())) + np.repeat(1 + np.arange(len(size)), size)
            seq[at] = codes[np.arange(int(size.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)])[:-1], size)]
            edges = np.concatenate([[0], np.cumsum(seq == EDGE)])
            for n in range(1, longest + 2):
                first = np.arange(len(seq) - n + 1)
                marks = edges[first + n] - edges[first]
                outer = (seq[first] == EDGE).astype(int) + ((seq[first + n - 1] == EDGE) if n > 1 else 0)
                valid = np.flatnonzero((marks == 0) | ((marks == 1) & (outer == 1) & (n > 1)))
                if not len(valid):
                    continue
                _, where, n_of = np.unique(_window_hashes(seq, n)[valid], return_index=True, return_counts=True)
                picked = seq[valid[where][:, None] + np.arange(n)]
                grams = picked.astype("<u4").view(f"<U{n}").reshape(-1).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n_of.astype(np.int64))], names=["gram", "n"])

    return run


def gram_counts(texts: DataFrame, longest: int = LONGEST, ranges: tuple = CJK) -> DataFrame:
    """``gram, n`` of the lower-cased column ``text``, in runs of the script; ``^`` stands for the end of a run."""
    return texts.select(F.lower("text").alias("text")).mapInArrow(_counted(longest, ranges), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def dictionary(texts: DataFrame, longest: int = LONGEST, ranges: tuple = CJK, least: int = LEAST, cohesion: float = COHESION, entropy: float = ENTROPY, most: int = MOST) -> DataFrame:
    """``word, n, cohesion, entropy``: the words of the corpus, the ``most`` most frequent ones (ties by word).

    ``cohesion`` is the least log ratio of a word's probability to the product of those of two parts; ``entropy`` the lesser one of the two sides, in nats. Single characters are words
    from ``least`` occurrences on, with a null cohesion and entropy.
    """
    grams = cut(gram_counts(texts, longest, ranges), "grams")
    plain = grams.where(~F.contains("gram", F.lit("^")))
    total = plain.where(F.length("gram") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    side = lambda key, name: grams.where(F.length("gram") > 1).groupBy(key.alias("gram")).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(name))
    after, before = side(F.expr("left(gram, length(gram) - 1)"), "after"), side(F.expr("substr(gram, 2)"), "before")
    long = plain.where((F.length("gram") > 1) & (F.length("gram") <= longest) & (F.col("n") >= least))
    parts = long.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k")).select("gram", "n", F.expr("left(gram, k)").alias("a"), F.expr("substr(gram, k + 1)").alias("b"))
    of = lambda k: plain.select(F.col("gram").alias(k), F.col("n").alias(f"n_{k}"))
    bound = parts.join(of("a"), "a").join(of("b"), "b").groupBy("gram").agg(F.min(F.log(F.col("n")) + F.log(F.lit(float(max(total, 1)))) - F.log("n_a") - F.log("n_b")).alias("cohesion"))
    words = long.join(bound, "gram").join(after, "gram").join(before, "gram").withColumn("entropy", F.least("after", "before")).where((F.col("cohesion") >= cohesion) & (F.col("entropy") >= entropy))
    single = plain.where((F.length("gram") == 1) & (F.col("n") >= least)).select(F.col("gram").alias("word"), "n", F.lit(None).cast("double").alias("cohesion"), F.lit(None).cast("double").alias("entropy"))
    every = words.select(F.col("gram").alias("word"), "n", "cohesion", "entropy").unionByName(single)
    return every.orderBy(F.desc("n"), "word").limit(most)


@dataclass(frozen=True)
class Words:
    """A dictionary as sorted hashes and log probabilities; ``unknown`` is the log probability of any other single character."""

    hashes: np.ndarray
    logs: np.ndarray
    longest: int
    unknown: float
    ranges: tuple

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """For each place and length the log probability of the sequence that ends there, -inf if it is no word."""
        out = np.full((len(codes), self.longest), -np.inf)
        for n in range(1, min(self.longest, len(codes)) + 1):
            h = _window_hashes(codes, n)
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                out[n - 1 :, n - 1] = np.where(self.hashes[at] == h, self.logs[at], -np.inf)
        out[:, 0] = np.where(np.isfinite(out[:, 0]), out[:, 0], self.unknown)
        return out


def load(words: DataFrame, ranges: tuple = CJK) -> Words:
    """The rows of a :func:`dictionary` (bounded by its ``most``) as arrays."""
    t = words.select("word", "n").toArrow()
    names, n = t["word"].to_pylist(), t["n"].to_numpy().astype(np.float64)
    if not names:
        return Words(np.zeros(0, _U), np.zeros(0), 1, -1.0, ranges)
    codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in names]
    hashes = np.array([_window_hashes(c, len(c))[0] for c in codes], _U)
    order = np.argsort(hashes)
    logs = np.log(n / n.sum())
    return Words(hashes[order], logs[order], max(map(len, codes)), float(np.log(UNKNOWN * n.min() / n.sum())), ranges)


def cut_runs(words: Words, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ends of all words of all runs, as places in ``codes``; of equally likely cuts the one with the longer last word."""
    value = words.lookup(codes)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    found, lo = [], 0
    while lo < len(order):
        longest_run = int(size[order[lo]])
        hi = min(len(order), lo + max(1, CELLS // (longest_run + 1)))
        mine = order[lo:hi]
        s, n = starts[mine], size[mine]
        best, step = np.full((longest_run + 1, len(mine)), -np.inf), np.zeros((longest_run + 1, len(mine)), np.int64)
        best[0] = 0.0
        live = len(mine)
        for i in range(1, longest_run + 1):
            while n[live - 1] < i:
                live -= 1
            for k in range(min(i, words.longest), 0, -1):
                t = best[i - k, :live] + value[s[:live] + i - 1, k - 1]
                better = t > best[i, :live]
                best[i, :live] = np.where(better, t, best[i, :live])
                step[i, :live] = np.where(better, k, step[i, :live])
        at, cols = n.copy(), np.arange(len(mine))
        while (at > 0).any():
            open_ = at > 0
            found.append(s[open_] + at[open_])
            at[open_] -= step[at[open_], cols[open_]]
        lo = hi
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def segment(docs: DataFrame, words: Words, key: str = "doc_id") -> DataFrame:
    """``key, terms``: the words of ``text``, lower-cased, in order: pieces of runs of the script, and runs of other word characters as they are.

    Null and empty texts have no words. ``words`` is broadcast with the task closure; its size is bounded by the dictionary's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in ((batch.column(0).slice(lo, len(part)), part) for batch in batches for lo, part in _slices(batch.column(1))):
            codes, offsets = _codes(texts)
            starts, ends = runs(codes, offsets, words.ranges)
            cuts = cut_runs(words, codes, starts, ends)
            # the plain pieces between: word characters outside the script
            whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            script = np.zeros(len(codes) + 1, np.int64)
            np.add.at(script, starts, 1)
            np.add.at(script, ends, -1)
            plain = (np.cumsum(script)[:-1] == 0) & np.fromiter((c.isalnum() or c == "_" for c in whole), bool, len(codes))
            edge = np.zeros(len(codes) + 1, bool)
            edge[offsets] = True
            p0 = np.flatnonzero(plain & (~np.concatenate([[False], plain[:-1]]) | edge[:-1]))
            p1 = np.flatnonzero(plain & (~np.concatenate([plain[1:], [False]]) | edge[1:])) + 1
            inner = cuts[~np.isin(cuts, ends)]
            begin = np.sort(np.concatenate([starts, inner]))
            a, b = np.concatenate([begin, p0]), np.concatenate([cuts, p1])
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            bounds = np.searchsorted(a, offsets)
            pieces = [whole[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pieces, pa.string()))
            yield pa.RecordBatch.from_arrays([keys, lists], names=[key, "terms"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.lower("text").alias("text")).mapInArrow(run, f"{key} {kind}, terms array<string>")

"""Byte-level BPE by rounds over padded numpy matrices, and its exact inverse.

A text is cut by the tokenizer's pattern; each distinct piece of a batch is encoded once. Pieces are
bucketed by length into matrices of token ids padded with -1. In each round every row finds its leftmost
pair of least rank through a hashed pair table, merges it and is compacted; rows without a known pair
leave. That is the order of merges of the plain algorithm, so ids are equal to it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrays import text_column

NONE = np.iinfo(np.int32).max
#: Distinct pieces whose ids a worker remembers; when full, the memory starts anew.
MEMORY = 400_000
#: Letters and numbers of the newest character tables, which the tokenizer library does not know as such.
NEWER_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEWER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


class Splitter:
    """The tokenizer's pattern, with a plain twin for texts within Latin-1 that needs no character tables."""

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern)
        self._newer = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]")
        known = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER_LETTERS}{NEWER_NUMBERS}]]")
        known = re.sub(r"\\p\{([LN])\}(?=\+)", lambda m: rf"[\p{{{m[1]}}}--[{NEWER_LETTERS if m[1] == 'L' else NEWER_NUMBERS}]]", known)
        self._strict = regex.compile(known, regex.V1)
        latin = [chr(i) for i in range(256)]
        inside = {c: "".join(re.escape(x) for x in latin if regex.match(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}
        out, in_set = [], False
        for part in re.findall(r"\\p\{[LN]\}|\\.|\[\^?|\]|.", pattern):
            if part in inside:
                out.append(inside[part] if in_set else f"[{inside[part]}]")
            elif part == r"\S":
                out.append(f"[^{inside[chr(92) + 's']}]")
            else:
                in_set = part[0] == "[" or (in_set and part != "]")
                out.append(part)
        self._latin = re.compile("".join(out))

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self._strict if self._newer.search(text) else self._any).findall(text)
        return self._latin.findall(text)


class PairTable:
    """Open-addressed hash table (left id, right id) -> merged id, as two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(merged)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, at = np.arange(len(key)), self._home(key)
        while len(todo):
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = key[todo[free]]
            won = self.keys[at[todo]] == key[todo]
            self.values[at[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs; ``NONE`` where no merge is known or an id is padding."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at, out = self._home(key), np.full(key.shape, NONE, np.int32)
        live = (left >= 0) & (right >= 0)
        while live.any():
            seen = self.keys[at]
            hit = live & (seen == key)
            out[hit] = self.values[at[hit]]
            live &= ~hit & (seen != -1)
            at = (at + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    """A byte-level BPE vocabulary. ``ranks`` maps token bytes to ids; a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = Splitter(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, i in ranks.items():  # any split into two known tokens may be merged into this one
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right)), np.array(merged, np.int32))
        digits = [b"%d," % i for i in range(len(self.tokens))]
        sizes = np.fromiter(map(len, digits), np.int64, len(digits))
        self._digits, self._digits_from = np.frombuffer(b"".join(digits), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self._bytes, self._bytes_from = np.frombuffer(b"".join(self.tokens), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._flat, self._from = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @classmethod
    def from_lines(cls, lines: tuple[str, ...], pattern: str) -> Codec:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each nonempty piece, by rounds of merges over matrices of pieces of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        for part, flat, count in self._rounds(pieces):
            for i, ids in zip(part.tolist(), np.split(flat, np.cumsum(count)[:-1]), strict=True):
                out[i] = ids
        return out

    def _rounds(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Which pieces a matrix held, their ids in one array and the number of ids of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.ceil(np.log2(np.maximum(sizes, 1)) * 2).astype(int)
        for b in np.unique(bucket[sizes > 0]):
            rows = np.flatnonzero((bucket == b) & (sizes > 0))
            step = max(1, (1 << 19) // int(sizes[rows].max()))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                yield part, *self._merge([pieces[i] for i in part.tolist()], sizes[part])

    def _merge(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((len(pieces), int(sizes.max())), -1, np.int32)
        ids[np.arange(ids.shape[1]) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        size, row = sizes.copy(), np.arange(len(pieces))
        done, count = np.full_like(ids, -1), np.zeros(len(pieces), np.int64)
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(row):
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(row)), at]
            else:
                at, best = np.zeros(len(row), int), np.full(len(row), NONE)
            ended = best == NONE
            done[row[ended], : ids.shape[1]] = ids[ended]
            count[row[ended]] = size[ended]
            live = ~ended
            row, at, best, size = row[live], at[live], best[live], size[live] - 1
            if not len(row):
                break
            ids, rank = ids[live], rank[live]
            # compaction: columns right of the merged pair move one to the left
            here, width = np.arange(len(row)), int(size.max())
            col = np.arange(width)
            src = col + (col > at[:, None])
            ids = np.take_along_axis(ids, src, axis=1)
            ids[here, at] = best
            ids[col >= size[:, None]] = -1
            if width > 1:
                rank = np.take_along_axis(rank, np.minimum(src[:, :-1], rank.shape[1] - 1), axis=1)
                rank[col[:-1] >= size[:, None] - 1] = NONE
                for near in (at - 1, at):  # only the pairs that touch the new token change
                    ok = (near >= 0) & (near + 1 < size)
                    rank[here[ok], near[ok]] = self.pairs.get(ids[here[ok], near[ok]], ids[here[ok], near[ok] + 1])
            else:
                rank = rank[:, :0]
        return done[done >= 0], count

    def _learn(self, cut: list[list[str]]) -> None:
        new = list(set().union(*cut).difference(self._known))
        if new and len(self._known) + len(new) > MEMORY:
            self._forget()
            new = list(set().union(*cut))
        flats, counts = [self._flat], [np.diff(self._from)]
        for part, flat, count in self._rounds([p.encode("utf-8", "surrogatepass") for p in new]):
            self._known.update(zip(map(new.__getitem__, part.tolist()), range(len(self._known), len(self._known) + len(part))))
            flats.append(flat)
            counts.append(count)
        if len(flats) > 1:
            self._flat, self._from = np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _ids(self, pieces: list[str]) -> np.ndarray:
        at = np.fromiter(map(self._known.__getitem__, pieces), np.int64, len(pieces))
        return _ragged(self._flat, self._from, at)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.split(t) for t in texts]
        self._learn(cut)
        return [self._ids(pieces) for pieces in cut]

    def decimal(self, ids: np.ndarray) -> bytes:
        """Ids in decimal, joined by commas."""
        return _ragged(self._digits, self._digits_from, ids)[:-1].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids."""
        return _ragged(self._bytes, self._bytes_from, np.asarray(ids, np.int64)).tobytes()


def _ragged(flat: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The items of ``rows`` of a ragged table, one after another."""
    n = start[rows + 1] - start[rows]
    end = np.cumsum(n)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start[rows] - end + n, n)]


class Vocabulary:
    """The lines of a rank file, read once on the driver and broadcast; workers build the codec once."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        with open(path) as f:
            self.lines = tuple(f.read().splitlines())
        self.key = path

    def __getstate__(self):
        return {"pattern": self.pattern, "lines": self.lines, "key": self.key}

    def codec(self) -> Codec:
        return _codec_of(self)


_CODECS: dict[tuple[str, int], Codec] = {}


def _codec_of(v: Vocabulary) -> Codec:
    key = (v.key, hash(v.lines[:64] + v.lines[-64:]))
    if key not in _CODECS:
        _CODECS[key] = Codec.from_lines(v.lines, v.pattern)
    return _CODECS[key]


TEXTS = 256


def map_texts(docs: DataFrame, vocabulary: Vocabulary, each: Callable, schema: str) -> DataFrame:
    """``each(codec, doc_id array, texts) -> RecordBatch`` over all rows, some hundred texts at a time."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value.codec()
        for batch in it:
            texts = text_column(batch, "text")
            for lo in range(0, batch.num_rows, TEXTS):
                yield each(c, batch.column(0).slice(lo, TEXTS), texts.slice(lo, TEXTS).to_pylist())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids`` (array of int) for every row; null text is encoded as empty. One narrow stage, no shuffle."""

    def each(c: Codec, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([x.tolist() for x in c.encode(texts)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_texts(docs, vocabulary, each, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, decoded`` (the bytes) from ``doc_id, ids``; null ids decode to no bytes."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value.codec()
        for batch in it:
            out = [c.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")

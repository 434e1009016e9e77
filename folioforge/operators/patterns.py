"""Many patterns in many texts: one pass over the bytes of whole texts, about ``BYTES`` at once, finds all of them, in numpy.

Patterns are grouped by their first bytes (four, or all of a shorter one). At every place of the text the group is looked up, first in a bitmap, then in a sorted array;
the patterns of the group that was met are compared byte by byte, all places of a batch at once, shrinking as they differ. What leaves a task is
``(row, pattern)`` pairs with counts, never texts. The cost is that of the text and of the places where a group matches, not texts times patterns.

UTF-8 keeps the bytes of one character out of another, so matches of bytes are matches of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, BITS = 4, 20
#: Patterns of one pass; more are searched in further passes over the texts.
MOST = 1 << 20
#: Places of one comparison.
SLICE = 1 << 22
#: Bytes of whole texts that are searched at once, so that a task's memory does not follow the size of its batches.
BYTES = 1 << 20


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes from each place on as one number."""
    out = np.zeros(max(len(data) - n + 1, 0), np.uint32)
    for k in range(n):
        out |= data[k : len(data) - n + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class _Group:
    size: int
    bitmap: np.ndarray
    heads: np.ndarray
    first: np.ndarray
    members: np.ndarray


class Patterns:
    """Distinct non-empty byte strings, ready to be searched; equal ones count once, with the number of the first."""

    def __init__(self, patterns: list[bytes]):
        known: dict[bytes, int] = {}
        for i, p in enumerate(patterns):
            if p:
                known.setdefault(p, i)
        self.number = np.array(list(known.values()), np.int64)
        self.length = np.array([len(p) for p in known], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(known), np.uint8)
        self.groups = []
        for n in range(1, HEAD + 1):
            mine = np.flatnonzero(np.minimum(self.length, HEAD) == n)
            if len(mine):
                head = np.zeros(len(mine), np.uint32)
                for k in range(n):
                    head |= self.bytes[self.begin[mine] + k].astype(np.uint32) << np.uint32(8 * k)
                order = np.argsort(head, kind="stable")
                heads, first = np.unique(head[order], return_index=True)
                bitmap = np.zeros(1 << BITS, bool)
                bitmap[self._slot(heads)] = True
                self.groups.append(_Group(n, bitmap, heads, np.concatenate([first, [len(mine)]]), mine[order]))

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and patterns (positions in ``number``) of all matches, overlapping ones included."""
        places, found = [], []
        for g in self.groups:
            codes = _codes(data, g.size)
            for lo in range(0, len(codes), SLICE):
                part = codes[lo : lo + SLICE]
                at = np.flatnonzero(g.bitmap[self._slot(part)])
                slot = np.minimum(np.searchsorted(g.heads, part[at]), len(g.heads) - 1)
                same = g.heads[slot] == part[at]
                at, slot = at[same] + lo, slot[same]
                each = g.first[slot + 1] - g.first[slot]
                place = np.repeat(at, each)
                offset = np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each)
                who = g.members[np.repeat(g.first[slot], each) + offset]
                fits = place + self.length[who] <= len(data)
                place, who = place[fits], who[fits]
                done = self.length[who] <= g.size
                places.append(place[done])
                found.append(who[done])
                place, who, k = place[~done], who[~done], g.size
                while len(place):
                    live = data[place + k] == self.bytes[self.begin[who] + k]
                    place, who, k = place[live], who[live], k + 1
                    done = self.length[who] == k
                    places.append(place[done])
                    found.append(who[done])
                    place, who = place[~done], who[~done]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(found)


def _searched(table: Patterns, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            every = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES, "right")) - 1)
                mine = offsets[lo : hi + 1] - offsets[lo]
                place, who = table.find(every[offsets[lo] : offsets[hi]])
                row = np.searchsorted(mine, place, "right") - 1
                inside = place + table.length[who] <= mine[row + 1]
                pair, n = np.unique(row[inside] * (len(table.number) + 1) + who[inside], return_counts=True)
                row, who = np.divmod(pair, len(table.number) + 1)
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(table.number[who]), pa.array(n.astype(np.int64))], names=[key, "number", "n"])
                lo = hi

    return run


def matches(texts: DataFrame, patterns: DataFrame, key: str = "doc_id", most: int = MOST) -> DataFrame:
    """``key, pattern, n``: how often each pattern of ``patterns (pattern)`` occurs in each row's ``text``, overlaps included; pairs that occur only.

    Null and empty patterns occur nowhere, null texts hold nothing; equal patterns count once, repeated rows each by themselves. Patterns go along with the
    tasks, ``most`` at once: more of them take further passes over the texts, so what is broadcast is bounded.
    """
    spark = texts.sparkSession
    wanted = patterns.select(F.col("pattern").cast("string").alias("pattern")).where("pattern <> ''").distinct()
    shards = max(1, -(-wanted.count() // most))
    kind, out = texts.schema[key].dataType.simpleString(), None
    for s in range(shards):
        mine = wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == s) if shards > 1 else wanted
        names = sorted(r["pattern"] for r in mine.toLocalIterator())
        table = Patterns([x.encode() for x in names])
        found = texts.select(key, F.col("text").cast("string").alias("text")).mapInArrow(_searched(table, key), f"{key} {kind}, number long, n long")
        numbered = spark.createDataFrame(list(enumerate(names)), "number long, pattern string")
        part = found.join(F.broadcast(numbered), "number").select(key, "pattern", "n")
        out = part if out is None else out.unionByName(part)
    return out

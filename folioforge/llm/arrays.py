"""Whole-text primitives on Arrow string buffers: words, hashes and windows without per-word Python objects.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``. UTF-8 never uses those bytes inside a longer
character, so working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_BASE = int(_rng.integers(2**40, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_CONT = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def xxhash64_long(values: np.ndarray) -> np.ndarray:
    """The hash that Spark's ``xxhash64`` gives for a bigint column, as uint64."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotl = lambda x, r: (x << U64(r)) | (x >> U64(64 - r))
    with np.errstate(over="ignore"):
        h = (U64(42) + p5 + U64(8)) ^ (rotl(values.astype(np.int64).view(U64) * p2, 31) * p1)
        h = rotl(h, 27) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
    return h ^ (h >> U64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=U64)
    return _POWERS["p"], _POWERS["i"]


def _drop_large_powers() -> None:
    """A very long text needs large power tables; they go when it is done."""
    if len(_POWERS.get("p", ())) > 8 * SLICE_BYTES:
        _POWERS.clear()


class SpanHasher:
    """64-bit polynomial hashes of any byte spans of one buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _powers(len(data) + 1)
        self._prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * power[: len(data)], out=self._prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._prefix[ends] - self._prefix[starts]) * self._inverse[starts]
        return mix(raw + (ends - starts).astype(U64))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    a = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(a.type) or pa.types.is_large_string(a.type)):
        a = a.cast(pa.string())
    return pc.fill_null(a, "") if a.null_count else a


def string_buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them."""
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    _, off, data = a.buffers()
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, name: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` of a batch with their bytes and offsets; about ``size`` bytes each, always whole texts."""
    data, offsets = string_buffers(text_column(batch, name))
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    _drop_large_powers()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_WINDOW = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) | U64(1)


def window_hashes(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows inside rows, and the first window of each row."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    total = np.zeros(len(at), U64)
    for k in range(width):
        total += word_hash[at + k] * _WINDOW[k]
    return mix(total), begin


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row; empty rows give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A row of fewer words has its whole word sequence as one shingle; a row without words has none.
    """
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = SpanHasher(data).spans(starts, ends)
    win, begin = window_hashes(h, first, width)
    out = []
    for i, n in enumerate(np.diff(first)):
        if n >= width:
            out.append(np.unique(win[begin[i] : begin[i + 1]]))
        elif n:
            short = h[first[i] : first[i + 1]]
            out.append(mix(np.array([np.sum(short * _WINDOW[32 : 32 + n], dtype=U64) + U64(n)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def ragged_binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())

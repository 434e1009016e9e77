"""Language-model scoring by deleted interpolation.

The probability of a token after its context is a mixture of maximum-likelihood estimates of all orders and of a uniform share for
tokens never seen. The weights depend on the bucket of the context: the longest stretch of it that the training counts hold, and the power of two below its
frequency. Weights are learned by expectation-maximisation on held-out counts: one training document in ``HELD`` is deleted from the counts, and what it holds is
predicted from the rest. The final estimates use all training documents.

How the counts travel. A task turns its documents into blocks of about ``BLOCK`` tokens: a local vocabulary and token numbers,
written once. The distinct grams of a block (64-bit hashes of all orders, sorted, packed) go to the shard of their hash with
their counts in the block; a shard adds up its blocks and answers each in the order asked, numbers without keys. A block and its answers then meet and
every token is scored where its text was cut up. So texts are read once, a hot word is one entry of a block, and what a task holds is bounded by a block or a
shard, whatever the corpus; no model is broadcast or gathered.

Expectation-maximisation reads the held-out blocks once: events are added up in cells of a bucket and the ratios of the estimates to the
uniform one, to a quarter of an octave. Cells are bounded by the buckets and the range of 64-bit counts, not by the corpus.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrays import LOWER, U64, SpanHasher, mix, row_sums, text_slices, words
from folioforge.storage import cut

ORDER, HELD = 2, 8
#: Tokens of a block and grams of a shard, about; a document is never divided.
BLOCK, SHARD = 1 << 20, 1 << 21
#: Ratios of estimates are told apart to so many cells an octave when weights are learned.
OCTAVE = 4
ROUNDS, ENOUGH = 200, 1e-7
#: Each bucket starts from the weights of all buckets together, as if it had seen so many events of them.
PRIOR = 20.0
LEARN, DELETED, OTHER = 0, 1, 2
_ORDER_BITS = U64(3)
_NEVER = -(1 << 15)
#: Hashes of the mark before a document and of the token after it; words have others.
START, END = (mix(np.array([k], U64)) & ~_ORDER_BITS for k in (0x5354415254, 0x454E44))


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed: narrowest width, bytes of equal weight together."""
    a = np.ascontiguousarray(a)
    top = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    raw = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return struct.pack("<BQ", width, len(a)) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(b: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", b)
    if not n:
        return np.zeros(0, U64)
    raw = np.frombuffer(pa.decompress(b[9:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").reshape(-1).astype(U64)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=U64)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, the end of each included, and how many each row has."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = SpanHasher(data).spans(starts, ends) & ~_ORDER_BITS
    return np.insert(h, first[1:], END[0]), np.diff(first) + 1


BLOCKS = "block long, role int, ids array<long>, sizes binary, vocab binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents ``(doc_id, text, role)`` as blocks of one role each."""
    held: dict[int, list] = {r: [] for r in (LEARN, DELETED, OTHER)}
    base, made = TaskContext.get().partitionId() << 24, 0

    def flush(role: int) -> pa.RecordBatch:
        nonlocal made
        ids = pa.concat_arrays([x[0] for x in held[role]])
        sizes, tokens = (np.concatenate([x[k] for x in held[role]]) for k in (1, 2))
        held[role] = []
        vocab, at = np.unique(tokens, return_inverse=True)
        made += 1
        cols = [pa.array([base + made], pa.int64()), pa.array([role], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in (pack(sizes), pack_sorted(vocab), pack(at)))]
        return pa.RecordBatch.from_arrays(cols, names=["block", "role", "ids", "sizes", "vocab", "tokens"])

    for batch in batches:
        ids, roles = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in text_slices(batch):
            tokens, sizes = token_hashes(data, offsets)
            row_role = roles[lo:hi]
            for role in np.unique(row_role).tolist():
                mine = row_role == role
                held[role].append((ids.slice(lo, hi - lo).filter(pa.array(mine)), sizes[mine], tokens[np.repeat(mine, sizes)]))
                if sum(len(x[2]) for x in held[role]) >= BLOCK:
                    yield flush(role)
    for role in held:
        if held[role]:
            yield flush(role)


class Grams:
    """All grams of a block: ``codes`` are its distinct hashes, sorted, ``places[k]`` where the grams of order k + 1 lie in them.

    Each document is preceded by ``order - 1`` start marks; ``start`` and ``real`` give the documents' first places and the tokens' places.
    """

    def __init__(self, sizes: bytes, vocab: bytes, tokens: bytes, order: int):
        self.sizes = unpack(sizes).astype(np.int64)
        seq = unpack_sorted(vocab)[unpack(tokens).astype(np.int64)]
        first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        pads = order - 1
        seq = np.insert(seq, np.repeat(first, pads), START[0])
        self.start = first + pads * np.arange(len(first))
        depth = np.arange(len(seq)) - np.repeat(self.start, self.sizes + pads)
        self.real = np.flatnonzero(depth >= pads)
        grams, begins = [seq], [seq]
        valid = [np.arange(len(seq))]
        for k in range(1, order):
            at = np.flatnonzero(depth >= k)
            h = np.zeros(len(seq), U64)
            h[at] = (mix(begins[-1][at - 1] * U64(0x9E3779B97F4A7C15) + seq[at]) & ~_ORDER_BITS) | U64(k)
            grams.append(h[at])
            begins.append(h)
            valid.append(at)
        self.codes, at, self.counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        self.places, lo = [], 0
        for v in valid:
            place = np.full(len(seq), -1, np.int64)
            place[v] = at[lo : lo + len(v)]
            self.places.append(place)
            lo += len(v)

    def events(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct events as places of their grams and of the contexts of these (one column an order, contexts from order 2), how often, and each token's event."""
        top = self.places[-1][self.real]
        kinds, at, n = np.unique(top, return_index=True, return_inverse=False, return_counts=True)
        where = self.real[at]
        gram = np.stack([p[where] for p in self.places], axis=1)
        context = np.stack([p[where - 1] for p in self.places[:-1]], axis=1) if len(self.places) > 1 else np.zeros((len(where), 0), np.int64)
        return gram, context, n, np.searchsorted(kinds, top)


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((codes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _asked(order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = Grams(row["sizes"], row["vocab"], row["tokens"], order)
                bounds = np.searchsorted(_shard_of(g.codes, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(bounds) > 0)
                parts = [(g.codes[bounds[s] : bounds[s + 1]], g.counts[bounds[s] : bounds[s + 1]]) for s in some]
                cols = [pa.array(some.astype(np.int32)), pa.array([row["block"]] * len(some), pa.int64()), pa.array([row["role"]] * len(some), pa.int32()), pa.array([pack_sorted(c) for c, _ in parts], pa.binary()), pa.array([pack(n) for _, n in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "block", "role", "codes", "counts"])

    return run, "shard int, block long, role int, codes binary, counts binary"


ANSWERS = "shard int, block long, role int, learned binary, deleted binary, tokens long, deleted_tokens long, types long"


def _answered(table: pa.Table) -> pa.Table:
    """The corpus counts of one shard for all blocks that ask: of training documents, and of the deleted ones among them."""
    rows = table.to_pylist()
    lists = [unpack_sorted(r["codes"]) for r in rows]
    codes, at = np.unique(np.concatenate(lists), return_inverse=True)
    learned, deleted = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    lo, slots = 0, []
    for r, x in zip(rows, lists, strict=True):
        slots.append(at[lo : lo + len(x)])
        lo += len(x)
        if r["role"] != OTHER:
            n = unpack(r["counts"]).astype(np.int64)
            learned[slots[-1]] += n
            if r["role"] == DELETED:
                deleted[slots[-1]] += n
    token = ((codes & _ORDER_BITS) == 0) & (codes != START[0])
    sums = [int(learned[token].sum()), int(deleted[token].sum()), int((learned[token] > 0).sum())]
    none = [0] * (len(rows) - 1)
    cols = [
        table.column("shard"), table.column("block"), table.column("role"), pa.array([pack(learned[s]) for s in slots], pa.binary()), pa.array([pack(deleted[s]) if r["role"] == DELETED else None for r, s in zip(rows, slots, strict=True)], pa.binary()),
        *(pa.array([x, *none], pa.int64()) for x in sums),
    ]
    return pa.table(cols, names=["shard", "block", "role", "learned", "deleted", "tokens", "deleted_tokens", "types"])


class Estimates:
    """Probabilities of every order for events, and the buckets of their contexts."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, counts: np.ndarray, tokens: int, types: int):
        n, c = counts[gram].astype(np.float64), counts[context].astype(np.float64)
        c = np.concatenate([np.full((len(gram), 1), float(tokens)), c], axis=1)
        self.uniform = 1.0 / (types + 1)
        self.each = np.divide(n, c, out=np.zeros_like(n), where=c > 0)
        longest = (c > 0).cumprod(axis=1).sum(axis=1)  # how many orders have a context that was seen
        last = np.take_along_axis(c, np.maximum(longest - 1, 0)[:, None], axis=1)[:, 0]
        self.bucket = np.where(longest <= 1, longest, longest * 64 + np.log2(np.maximum(last, 1)).astype(np.int64))
        self.known = n[:, 0] > 0
        self.count = n[:, 0]


def orders_in(bucket: int) -> int:
    """How many orders the contexts of a bucket have estimates for."""
    return bucket if bucket <= 1 else bucket // 64


def learn(cells: list[tuple[int, list[int], int]], order: int) -> dict[int, np.ndarray]:
    """Weights by bucket (uniform share first, then the orders) from cells ``(bucket, ratios, events)`` by expectation-maximisation."""

    def fit(ratio: np.ndarray, n: np.ndarray, start: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w, before = start, -np.inf
        for _ in range(ROUNDS):
            p = ratio @ w
            w = prior + (n / p) @ ratio * w
            w = w / w.sum()
            gain = float(n @ np.log(p))
            if gain - before <= ENOUGH * abs(gain):
                break
            before = gain
        return w

    found: dict[int, np.ndarray] = {}
    by_orders: dict[int, list] = {}
    for bucket, q, n in cells:
        by_orders.setdefault(orders_in(bucket), []).append((bucket, q, n))
    for held in range(order + 1):
        own = by_orders.get(held, [])
        plain = np.full(held + 1, 1.0 / (held + 1))
        if held and own:
            q = np.array([x[1][:held] for x in own], np.float64)
            ratio = np.concatenate([np.ones((len(own), 1)), np.where(q == _NEVER, 0.0, 2.0 ** (q / OCTAVE))], axis=1)
            n, buckets = np.array([x[2] for x in own], np.float64), np.array([x[0] for x in own])
            plain = fit(ratio, n, plain, np.ones(held + 1))
            for b in np.unique(buckets).tolist():
                mine = buckets == b
                found[b] = fit(ratio[mine], n[mine], plain, PRIOR * plain)
        found[-held] = plain  # for buckets without events
    return found


def _padded(weights: dict[int, np.ndarray], bucket: np.ndarray, order: int) -> np.ndarray:
    kinds, at = np.unique(bucket, return_inverse=True)
    rows = np.zeros((len(kinds), order + 1))
    for i, b in enumerate(kinds.tolist()):
        w = weights.get(b) if b > 0 else None
        w = weights[-orders_in(b)] if w is None else w
        rows[i, : len(w)] = w
    return rows[at]


def _whole(table: pa.Table, column: str) -> np.ndarray:
    parts = sorted(zip(table.column("shard").to_pylist(), table.column(column).to_pylist(), strict=True))
    return np.concatenate([unpack(b) for _, b in parts]).astype(np.int64)


def score(docs: DataFrame, learn_from: Column, order: int = ORDER) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs (doc_id, text)``, learned where ``learn_from`` holds.

    Tokens are runs of bytes outside white space, A-Z lower-cased, and one end of each text; null and empty texts have the end alone. ``base_score`` sums
    log10 of add-one unigram estimates, ``score`` is the log10 probability of the whole token sequence under the mixture. Orders 1 to 4.

    Every row is scored, and learned from if asked, by itself: repeated rows and ids count as often as they come. A row with a null doc_id or a null ``learn_from`` is
    scored and never learned from. Without training rows every token has the probability 1. Tokens and grams are told apart by 62-bit hashes. Other columns are ignored; an
    empty table gives no rows. ``doc_id`` comes back as a bigint.
    """
    if not 1 <= order <= 4:
        raise ValueError("orders 1 to 4")
    key = F.col("doc_id").cast("long")
    lesson = F.coalesce(learn_from & key.isNotNull(), F.lit(False))
    role = F.when(~lesson, OTHER).when(F.pmod(F.xxhash64(key), F.lit(HELD)) == 0, DELETED).otherwise(LEARN)
    blocks = cut(docs.select(key.alias("doc_id"), "text", role.alias("role")).mapInArrow(_blocks, BLOCKS), "blocks")
    weight = F.coalesce(F.sum(F.octet_length("vocab") + F.octet_length("tokens")), F.lit(0))
    shards = max(1, -(-int(blocks.agg(weight).first()[0]) * order // (2 * SHARD)))
    ask, shape = _asked(order, shards)
    answers = cut(blocks.select("block", "role", "sizes", "vocab", "tokens").mapInArrow(ask, shape).groupBy("shard").applyInArrow(_answered, ANSWERS), "answers")
    tokens, deleted, types = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("deleted_tokens"), F.sum("types")).first())

    def cells(mine: pa.Table, said: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        gram, context, n, _ = Grams(row["sizes"], row["vocab"], row["tokens"], order).events()
        e = Estimates(gram, context, _whole(said, "learned") - _whole(said, "deleted"), tokens - deleted, types)
        with np.errstate(divide="ignore"):
            q = np.where(e.each > 0, np.rint(OCTAVE * np.log2(e.each / e.uniform)), _NEVER).astype(np.int64)
        kinds, at = np.unique(np.concatenate([e.bucket[:, None], q], axis=1), axis=0, return_inverse=True)
        total = np.bincount(at.reshape(-1), weights=n, minlength=len(kinds)).astype(np.int64)
        ratios = pa.ListArray.from_arrays(pa.array(np.arange(len(kinds) + 1) * order, pa.int32()), pa.array(kinds[:, 1:].reshape(-1)))
        return pa.table([pa.array(kinds[:, 0]), ratios, pa.array(total)], names=["bucket", "ratios", "n"])

    def held(role_: int):
        return blocks.where(F.col("role") == role_).groupBy("block").cogroup(answers.where(F.col("role") == role_).groupBy("block"))

    gathered = held(DELETED).applyInArrow(cells, "bucket long, ratios array<long>, n long").groupBy("bucket", "ratios").agg(F.sum("n").alias("n")).toArrow()
    weights = learn([(r["bucket"], r["ratios"], r["n"]) for r in gathered.to_pylist()], order)

    def scored(mine: pa.Table, said: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        g = Grams(row["sizes"], row["vocab"], row["tokens"], order)
        gram, context, _, at = g.events()
        e = Estimates(gram, context, _whole(said, "learned"), tokens, types)
        w = _padded(weights, e.bucket, order)
        full = np.log10(w[:, 0] * e.uniform + (w[:, 1:] * e.each).sum(axis=1))
        base = np.log10((e.count + 1) / (tokens + types + 1))
        first = np.concatenate([[0], np.cumsum(g.sizes)])
        total = [row_sums(x[at], first) for x in (e.known.astype(np.int64), base, full)]
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(g.sizes), *map(pa.array, total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    shape = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, shape)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")

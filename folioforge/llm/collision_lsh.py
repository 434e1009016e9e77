"""Near-duplicate vectors by collision counting over many sorted one-dimensional projections.

A unit vector has 2 x ``PROJECTIONS`` one-dimensional projections: onto random directions and their opposites. Its
``COUNTED`` largest values name the projections in whose upper tail it lies. Two vectors collide in a projection if
both lie in its tail. A vector is entered into the ``LISTS`` lists of its largest values. Each list is sorted by value; the
window of half-width ``HALF`` standard deviations (of the difference of a pair at the threshold) centred on a query
picks its partners. The list of the least number that two vectors share counts their collisions over all
``COUNTED`` tails; a pair with enough of them is verified there by its cosine in double precision, so every pair is
verified once. How many are enough is calibrated on random pairs at the threshold, through the whole procedure.

Why tails: of vectors at a cosine of 0.93 both lie in a common far tail almost always, of others hardly ever, whereas
a window in the middle of a projection holds a fifth of all vectors and more. Two vectors without relation share a list
with a chance of LISTS**2 / (2 * PROJECTIONS) = 0.06, and each vector is dealt LISTS times whatever the size of its label.

Vectors are compared within a label only; equal vectors are one class. A list longer than ``BLOCK`` is dealt into blocks, and
a task compares two of them. Tasks return link counts and one spanning link per vector, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from folioforge.llm.components import connected_components
from folioforge.llm.skew import hot_bar, split_join
from folioforge.storage import cut

PROJECTIONS, LISTS, COUNTED, HALF, SEED = 512, 8, 24, 4.0, 9
#: Random pairs at the threshold that calibrate the count, and of how many found ones it may lose one.
TRIALS, LOSS = 4000, 1000
BLOCK, PAIRS, ROWS = 4096, 1 << 16, 1 << 15


@lru_cache(maxsize=4)
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, PROJECTIONS))


def tails(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ``COUNTED`` projections with the largest values of each row, largest first, and these values."""
    v = unit @ directions(unit.shape[1])
    v = np.concatenate([v, -v], axis=1)
    top = np.argpartition(-v, COUNTED - 1, axis=1)[:, :COUNTED]
    value = np.take_along_axis(v, top, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int16), np.take_along_axis(value, order, axis=1)


def bitmaps(numbers: np.ndarray) -> np.ndarray:
    """Sets of projection numbers as rows of bits."""
    out = np.zeros((len(numbers), 2 * PROJECTIONS), bool)
    np.put_along_axis(out, numbers.astype(np.int64), True, axis=1)
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many projections the sets of bits of each pair of rows share."""
    return np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)


@lru_cache(maxsize=16)
def calibrated(dim: int, threshold: float) -> tuple[int, float]:
    """One less than the count that all but one in ``LOSS`` of the found random pairs at the threshold reach, and the share found so."""
    if dim < 2:
        return 1, 1.0
    rng = np.random.default_rng(SEED + 1)
    found, counts = 0, []
    for _ in range(TRIALS // 1000):
        a, w = rng.normal(size=(2, 1000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        w -= (w * a).sum(axis=1, keepdims=True) * a
        b = threshold * a + math.sqrt(1 - threshold**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        (ta, va), (tb, vb) = tails(a), tails(b)
        shared = ta[:, :LISTS, None] == tb[:, None, :LISTS]
        number = np.where(shared, ta[:, :LISTS, None], 2 * PROJECTIONS).reshape(len(a), -1)
        at = number.argmin(axis=1)
        gap = np.abs(va[:, :LISTS, None] - vb[:, None, :LISTS]).reshape(len(a), -1)[np.arange(len(a)), at]
        ok = shared.any(axis=(1, 2)) & (gap <= half_width(threshold))
        found += int(ok.sum())
        counts.append(collisions(bitmaps(ta), bitmaps(tb))[ok])
    n = np.sort(np.concatenate(counts))
    least = max(1, int(n[len(n) // LOSS]) - 1)
    return least, float((n >= least).sum() / TRIALS)


def half_width(threshold: float) -> float:
    return HALF * math.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-9


def _prepare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors and digests; null for vectors that are null or zero or hold null or non-finite components, and without id or label."""
    for batch in it:
        out: list[tuple] = []
        for i, label, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            same = unit = None
            if v and None not in v and i is not None and label is not None:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top  # no overflow in the norm
                    unit = (x / np.sqrt((x * x).sum())).tobytes()
                    same = hashlib.blake2b(unit, digest_size=16).digest()
            out.append((i, label, same, unit))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["vec_id", "label", "same", "unit"])


def _enter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each class: one for each of its lists, with its tails and its vector."""
    for batch in it:
        dim = batch.column(1).to_numpy() // 8
        for d in np.unique(dim):
            part = batch.filter(pa.array(dim == d))
            for lo in range(0, part.num_rows, 2048):
                rows = part.slice(lo, 2048)
                unit = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.float64).reshape(rows.num_rows, d)
                number, value = tails(unit)
                mine = np.repeat(np.arange(rows.num_rows), LISTS)
                packed = pa.array([x.tobytes() for x in number], pa.binary()).take(pa.array(mine))
                cols = [rows.column(k).take(pa.array(mine)) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(number[:, :LISTS].ravel().astype(np.int32)), pa.array(value[:, :LISTS].ravel()), packed], names=["label", "dim", "node", "copies", "unit", "list", "value", "tails"])


ENTRY = "label long, dim int, node long, copies long, unit binary, list int, value double, tails binary"


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def window_pairs(run: np.ndarray, value: np.ndarray, half: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows sorted by (run, value) that lie in one run, j in the window centred on i; some at a time."""
    place = run * (4 * np.abs(value).max(initial=1.0) + 4 * half) + value
    stop = np.searchsorted(place, place + half, "right")
    n = np.maximum(stop - np.arange(len(place)) - 1, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    for lo in range(0, int(begin[-1]), PAIRS):
        k = np.arange(lo, min(lo + PAIRS, int(begin[-1])))
        i = np.searchsorted(begin, k, "right") - 1
        yield i, i + 1 + k - begin[i]


def _compare(threshold: float):
    half = half_width(threshold)

    def task(rows: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        least, _ = calibrated(dim, threshold)
        label, number, bi, bj, block, node, copies, value = (rows.column(c).to_numpy() for c in ("label", "list", "bi", "bj", "block", "node", "copies", "value"))
        number = number.astype(np.int64)
        unit = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(node), dim)
        tail = np.frombuffer(b"".join(rows.column("tails").to_pylist()), np.int16).reshape(len(node), COUNTED)
        counted, leads = bitmaps(tail), bitmaps(tail[:, :LISTS])
        # lists of a smaller number: a pair that shares one is verified there
        bits = np.clip(number[:, None] - np.arange(leads.shape[1]) * 64, 0, 64).astype(np.uint64)
        below = leads & np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
        edge = np.concatenate([[False], (label[1:] != label[:-1]) | (number[1:] != number[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        run = np.cumsum(edge)
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        for i, j in window_pairs(run, value, half):
            ok = ((bi[i] == bj[i]) | (block[i] != block[j])) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            ok = ~(below[i] & leads[j]).any(axis=1)
            i, j = i[ok], j[ok]
            ok = collisions(counted[i], counted[j]) >= least
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for u, v in zip(i.tolist(), j.tolist(), strict=True):
                ru, rv = _root(parent, u), _root(parent, v)
                if ru != rv:
                    parent[max(ru, rv)] = min(ru, rv)
        hit = np.flatnonzero(links)
        root = np.array([_root(parent, k) for k in hit.tolist()], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[root] if len(root) else node[:0])], names=["node", "links", "root"])

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in rows:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim):
                yield task(batch.filter(pa.array(dim == d)), int(d) // 8)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole runs of one list and two blocks, many at a time; the input is sorted by them, then by value."""
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            if held and sum(b.num_rows for b in held) + batch.num_rows > ROWS:
                key = [np.concatenate([held[-1].column(c).to_numpy()[-1:], batch.column(c).to_numpy()]) for c in ("label", "dim", "list", "bi", "bj")]
                change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
                if len(change):
                    if change[0]:
                        held.append(batch.slice(0, change[0]))
                    yield from whole(held)
                    held, batch = [], batch.slice(change[0])
            held.append(batch)
        if held:
            yield from whole(held)

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per input row of ``vec_id, embedding, label``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or vec_id, link
    with nothing, as do vectors of other lengths. Labels may be of any type. Every row is a vector of its own, with its own
    links, also if it repeats a vec_id; rows that share a vec_id share its component. A null vec_id gets a null
    component and is kept. Other columns are ignored. An empty table gives no rows.
    """
    long = lambda x: F.lit(x).cast("long")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    if isinstance(v.schema["label"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        v = v.withColumn("label", F.col("label").cast("long"))
    else:  # labels of other types are numbered
        names = cut(v.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("size")).where("name is not null").withColumn("number", F.monotonically_increasing_id()), "labels")
        named = split_join(v.where("label is not null").withColumnRenamed("label", "name"), names, ["name"], "size").select("vec_id", F.col("number").alias("label"), "embedding")
        v = named.unionByName(v.where("label is null").withColumn("label", F.lit(None).cast("long")))
    ready = cut(v.select("vec_id", "label", "embedding").mapInArrow(_prepare, "vec_id long, label long, same binary, unit binary"), "units")
    sound = ready.where("same is not null")
    classes = sound.groupBy("label", "same").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    # numbered where it is written, once; a retried task commits its own numbers or none
    classes = cut(classes.select("label", "same", "first", "copies", F.length("unit").alias("dim"), F.monotonically_increasing_id().alias("node"), "unit"), "classes")
    entries = cut(classes.select("label", "dim", "node", "copies", "unit").mapInArrow(_enter, ENTRY), "entries")
    key = ["label", "dim", "list"]
    sizes = cut(entries.groupBy(*key).agg(F.count("*").alias("size")), "sizes")
    bar, hot = hot_bar(sizes, "size", BLOCK, 1 << 20)
    dealt = entries.withColumns({"block": long(0), "bi": long(0), "bj": long(0)})
    if hot:
        lists = F.broadcast(sizes.where(F.col("size") >= bar).select(*key, F.ceil(F.col("size") / BLOCK).alias("blocks")))
        split = entries.join(lists, key).withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("with", F.explode(F.sequence(long(0), F.col("blocks") - 1)))
        split = split.withColumn("bi", F.least("block", "with")).withColumn("bj", F.greatest("block", "with")).drop("blocks", "with")
        dealt = dealt.join(lists.select(*key), key, "left_anti").unionByName(split)
    order = [*key, "bi", "bj"]
    found = dealt.repartition(*order).sortWithinPartitions(*order, "value", "node").mapInArrow(_compare(threshold), "node long, links long, root long")
    found = cut(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    member = sound.select("vec_id", "label", "same").distinct()
    shared = member.groupBy("vec_id").agg(F.count("*").alias("vectors")).where("vectors > 1")
    shared = cut(member.join(shared, "vec_id").join(classes.select("label", "same", "node"), ["label", "same"]).select("vec_id", "node"), "shared")
    if not shared.isEmpty():
        edges = edges.union(shared.join(shared.groupBy("vec_id").agg(F.min("node").alias("a")), "vec_id").select("a", F.col("node").alias("b")))
    label = connected_components(edges)
    least = label.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    groups = classes.select("label", "same", "node", "first", "copies").join(links, "node", "left").join(label.join(least, "component").select("node", "component_id"), "node", "left")
    groups = cut(groups.select("label", "same", "copies", (F.coalesce("links", long(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")), "groups")
    known = split_join(sound.select("vec_id", "label", "same"), groups, ["label", "same"], "copies").select("vec_id", "n_links", "component_id")
    out = known.unionByName(ready.where("same is null").select("vec_id", long(0).alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

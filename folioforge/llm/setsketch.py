"""Near-duplicate documents by SetSketch registers, a joint likelihood and a check on full sets.

Every document's set of word shingles becomes ``M`` registers. Register i is
``floor(1 - log_b(x))``, cut to [0, q + 1], where x is the smallest of the exponential variates that
hash function i gives the members: exponentially spaced, truncated minima. Registers of a union are
register maxima, so sketches merge; equal registers are likelier the more two sets overlap, so groups of
``ROWS`` registers are hashed into ``BANDS`` bucket keys.

Order of work, so that no group of copies is ever expanded into all its pairs:

1. rows with equal sets are one class, a node of its own number; one row of the class, the first by doc_id
   and text hash, stands for it;
2. in every bucket all members meet the bucket's smallest node; a pair goes on unless the joint
   likelihood of its registers and set sizes speaks against the threshold; what is left is verified on
   full sets, which gives links and components;
3. in a bucket that holds several components, the members outside its largest one meet all others in
   blocks of bounded size, where their registers are compared; the largest component goes out once, a block a
   task. Of a member's partners that pass, the ``BEST`` likeliest are verified first, which joins most
   members of a large group to it;
4. what still lies in different components meets once more; members with a partner whose registers pass are
   dealt again with their full sets, so that every such pair is verified where it is found and only links
   are returned;
5. the components of all verified links are final. Classes become doc_ids only then.

Recall: a pair at the threshold misses all bands with a probability of about 5e-6 and fails the
likelihood test with about 3e-5. A verified link is exact up to collisions of 64-bit shingle hashes; rows are
told apart by doc_id and a 64-bit hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import bloom
from folioforge.llm.arrays import U64, mix, shingle_sets, text_slices
from folioforge.llm.components import connected_components
from folioforge.llm.skew import split_join
from folioforge.storage import cut

ROWS, BANDS = 4, 32
M = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 2**15 - 2
BLOCK, PAIRS = 512, 8192
#: Log-likelihood by which the best similarity may beat the threshold before a pair is dropped.
SLACK = 8.0
#: Partners of a member that the first pass over mixed buckets verifies.
BEST = 2

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**63, M, dtype=np.int64).astype(U64)
_ODD = _rng.integers(2**40, 2**62, M, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def registers(members: np.ndarray) -> np.ndarray:
    """The registers of one nonempty set of 64-bit hashes."""
    low = np.full(M, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(members), 4096):
        part = members[at : at + 4096]
        np.minimum(low, ((part[:, None] ^ _XOR) * _ODD).min(axis=0), out=low)
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    x = np.maximum(-np.log1p(-np.minimum(u, 1 - 1e-16)), 1e-300) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.int16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sketched sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Bucket keys (rows x BANDS) of register rows."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.int64).view(U64)
    h = np.zeros((len(regs), BANDS), U64) + np.arange(1, BANDS + 1, dtype=U64)
    for k in range(ROWS):
        h = mix(h * U64(0x9E3779B97F4A7C15) + r[:, :, k])
    return h


def _log_likelihood(j, up, down, same, u, v):
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pu, pd = p(u - v * j), p(v - u * j)
    safe = lambda n, q: np.where(n > 0, n * np.log(np.maximum(q, 1e-12)), 0.0)
    return safe(up, pu) + safe(down, pd) + safe(same, 1 - pu - pd)


def passes(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of register rows and set sizes are compatible with a Jaccard similarity at the threshold.

    The joint likelihood (counts of larger, smaller and equal registers given both sizes) is taken at
    the threshold and at its maximum over a grid; a pair fails if a lower similarity is much likelier.
    """
    na, nb = np.broadcast_arrays(np.asarray(na, float), np.asarray(nb, float))
    up, down = (ra > rb).sum(axis=-1), (ra < rb).sum(axis=-1)
    same = ra.shape[-1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    out = np.zeros(len(same), bool)
    # sizes or shares of equal registers more than six deviations short of the threshold need no likelihood
    near = np.flatnonzero((most >= threshold - 1e-12) & (same >= ra.shape[-1] * threshold - 6.5 * np.sqrt(ra.shape[-1] * threshold * (1 - threshold)) - 1))
    up, down, same, u, v, most = (x[near] for x in (up, down, same, u, v, most))
    at = _log_likelihood(np.minimum(threshold, most), up, down, same, u, v)
    best = at.copy()
    for j in np.linspace(0, 0.98, 50) * threshold:
        best = np.maximum(best, _log_likelihood(np.minimum(j, most), up, down, same, u, v))
    out[near] = best - at <= SLACK
    return out


def _sketch(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0)
            for lo, hi, data, off in text_slices(batch):
                sets = shingle_sets(data, off, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "key", "n_shingles", "same", "regs"],
                )

    return run


def _bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "node"])


def _matrix(a: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(a.to_pylist()), np.int16).reshape(-1, M)


def _estimate(threshold: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                ok = passes(_matrix(batch.column(4)), _matrix(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _runs(it: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys, across batches; the input is sorted by the key."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in key])
        edges = np.concatenate([[0], np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(cols[:, lo])
            if held and now != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)


def _overlap(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes reach the threshold."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b) or 100 * len(b) < percent * len(a):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compared(t: pa.Table, within: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of one block task whose members lie in different components and whose registers pass; their equal registers.

    Members of part 0 meet those of part 1, or each other ``within`` a block. The bucket's hub has met all of them before.
    """
    node, comp, n, part = (t.column(c).to_numpy() for c in ("node", "component", "n", "part"))
    regs, hub = _matrix(t.column("regs").combine_chunks()), t.column("hub")[0].as_py()
    left, right = (np.flatnonzero((part == k) & (node != hub)) for k in (0, 1))
    if within:
        i, j = np.triu_indices(len(left), 1)
        i, j = left[i], left[j]
    else:
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    apart = comp[i] != comp[j]
    i, j = i[apart], j[apart]
    near = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent  # sizes alone rule most strangers out
    i, j = i[near], j[near]
    ok, equal = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
    for lo in range(0, len(i), PAIRS):
        at = slice(lo, lo + PAIRS)
        a, b = regs[i[at]], regs[j[at]]
        ok[at], equal[at] = passes(a, b, n[i[at]], n[j[at]], percent / 100), (a == b).sum(axis=1)
    return i[ok], j[ok], equal[ok]


def _tasks(it: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple]:
    for key, t in _runs(it, ["key", "bi", "bj"]):
        i, j, equal = _compared(t, key[1] == key[2], percent)
        if len(i):
            yield key, t, i, j, equal


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _best(percent: int):
    """For each member the ``BEST`` partners with the most equal registers, of those that pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, i, j, equal in _tasks(it, percent):
            order = np.lexsort((-equal, i))
            i, j = i[order], j[order]
            begin = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1])
            keep = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i)))) < BEST
            node = t.column("node").to_numpy()
            yield _edges(node[i[keep]], node[j[keep]])

    return run


def _involved(percent: int):
    """Which rows of a task have a partner whose registers pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, bi, bj), t, i, j, _ in _tasks(it, percent):
            node = t.column("node").to_numpy()[np.unique(np.concatenate([i, j]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), x)) for x in (key, bi, bj)] + [pa.array(node)], names=["key", "bi", "bj", "node"])

    return run


def _confirmed(percent: int):
    """The pairs of a task whose registers pass and whose full sets, which the rows bring, reach the threshold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, i, j, _ in _tasks(it, percent):
            sets = [np.frombuffer(m.as_buffer(), U64) for m in t.column("members").combine_chunks()]
            node = t.column("node").to_numpy()
            keep = np.array([_overlap(sets[p], sets[q], percent) for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
            yield _edges(node[i[keep]], node[j[keep]])

    return run


def _sets(width: int, wanted):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(pa.array(bloom.might_contain(wanted.value, batch.column(0).to_numpy())))
            for lo, hi, data, off in text_slices(batch):
                sets = shingle_sets(data, off, width)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "key", "members"])

    return run


def _confirm(percent: int):
    """Streams (a, salt, b, members): the row with b null brings a's own set, then come its partners."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_id = np.zeros(0, U64), None
        for batch in it:
            a, b, members = (batch.column(i) for i in (0, 2, 3))
            left, right = [], []
            for x, y, m in zip(a.to_pylist(), b.to_pylist(), members, strict=True):
                s = np.frombuffer(m.as_buffer(), U64)
                if y is None:
                    own, own_id = s, x
                elif x == own_id and _overlap(own, s, percent):
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``node, members`` (sorted shingle hashes) of distinct nodes, from the rows that stand for their classes."""
    ids = cut(classes.join(nodes, "node").select("node", "doc_id", "key"), "wanted")
    wanted = docs.sparkSession.sparkContext.broadcast(bloom.build(ids, "doc_id"))
    sets = docs.where("doc_id is not null").select("doc_id", "key", "text").mapInArrow(_sets(width, wanted), "doc_id long, key long, members binary")
    return cut(sets.join(ids, ["doc_id", "key"]).select("node", "members").dropDuplicates(["node"]), "sets")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets reach the threshold.

    Only texts that pass a bitmap of the wanted ids are read into sets. A node with many partners is
    dealt out in salted groups of about 256, each of which gets that node's set once.
    """
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs, width)
    salts = cut(pairs.groupBy("a").agg(F.count("*").alias("pairs")).withColumn("salts", F.ceil(F.col("pairs") / 256)), "salts")
    partners = split_join(pairs, salts, ["a"], "pairs").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.col("b").alias("node")).join(sets, "node").select("a", "salt", F.col("node").alias("b"), "members")
    owners = salts.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(sets, "node").select(F.col("node").alias("a"), "salt", F.lit(None).cast("long").alias("b"), "members")
    dealt = partners.unionByName(owners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_confirm(percent), "a long, b long")


def _mixed(hits: DataFrame, reps: DataFrame, label: DataFrame) -> DataFrame:
    """Members of buckets that hold different components, dealt into block tasks ``key, bi, bj``.

    With L members in the bucket's largest component and s others, L + s ceil(L / BLOCK) + s ceil(s / BLOCK) rows go out:
    tasks (b, -1) hold block b of the large side and all others, tasks (bi, bj) two blocks of the others.
    """
    long = lambda x: F.lit(x).cast("long")
    open_ = hits.where("size > 2").select("key", "node", "hub").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = open_.groupBy("key", "component").agg(F.count("*").alias("n"))
    sides = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size")).where("top.n < size")
    sides = cut(sides.select("key", "size", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / BLOCK).alias("large"), F.ceil((F.col("size") - F.col("top.n")) / BLOCK).alias("small")), "sides")
    rows = split_join(open_, sides, ["key"], "size")
    upto = lambda n: F.sequence(long(0), F.col(n) - 1)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("component") == F.col("main"), F.col("large")).otherwise(F.col("small")))
    rows = rows.withColumn("own", own)
    to = lambda bi, bj, part: F.struct(bi.alias("bi"), bj.alias("bj"), part.alias("part"))
    meet_large = F.transform(upto("large"), lambda b: to(b, long(-1), F.lit(0)))
    meet_small = F.transform(upto("small"), lambda b: to(F.least(b, "own"), F.greatest(b, "own"), (F.col("own") > b).cast("int")))
    tasks = F.when(F.col("component") == F.col("main"), F.array(to(F.col("own"), long(-1), F.lit(1)))).otherwise(F.concat(meet_large, meet_small))
    return rows.select("key", "hub", "node", "component", F.inline(tasks)).join(reps, "node").select("key", "bi", "bj", "part", "hub", "node", "component", "n", "regs")


def _run_tasks(dealt: DataFrame, each, schema: str) -> DataFrame:
    return dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(each, schema).distinct()


PAIR = "a long, b long"


def linked_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (doc_id, key, text): sketches (doc_id, key, n_shingles, same), classes (node, same, doc_id, key) and links (a, b) of nodes."""
    threshold = percent / 100
    sketches = cut(docs.select("doc_id", "key", "text").mapInArrow(_sketch(width), "doc_id long, key long, n_shingles long, same binary, regs binary"), "sketches")
    full = sketches.where("same is not null and doc_id is not null")
    classes = full.groupBy("same").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies"))
    # numbered where it is written, once; a retried task commits its own numbers or none
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "same", "rep.doc_id", "rep.key", "n", "regs", "copies"), "classes")
    reps = classes.select("node", "n", "regs")

    bands = reps.select("node", "regs").mapInArrow(_bands, "key long, node long")
    buckets = cut(bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    hits = cut(split_join(bands, buckets, ["key"], "size"), "hits")

    star = cut(hits.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
    hubs = cut(star.groupBy("a").agg(F.count("*").alias("size")).join(reps.toDF("a", "na", "ra"), "a"), "hubs")
    star = split_join(star.join(reps.toDF("b", "nb", "rb"), "b"), hubs, ["a"], "size")
    star = star.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimate(threshold), PAIR)
    links = cut(verify(cut(star, "likely"), classes, docs, width, percent), "links")

    likely = cut(_run_tasks(_mixed(hits, reps, connected_components(links)), _best(percent), PAIR), "likely")
    links = cut(links.union(verify(likely, classes, docs, width, percent)), "links")
    dealt = cut(_mixed(hits, reps, connected_components(links)), "mixed")
    task = ["key", "bi", "bj", "node"]
    involved = cut(_run_tasks(dealt, _involved(percent), "key long, bi long, bj long, node long"), "involved")
    if not involved.isEmpty():
        dealt = dealt.join(involved, task, "left_semi").join(full_sets(involved.select("node").distinct(), classes, docs, width), "node")
        links = cut(links.union(_run_tasks(dealt, _confirmed(percent), PAIR)), "links")
    return sketches.drop("regs"), classes.drop("n", "regs"), links


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A text that is null, empty or without words has an empty set, is its own component and is kept. Rows
    with a null doc_id cannot be named: component_id is null and they are kept. Rows that share a doc_id are one
    document for reachability, whatever their texts: every text that has words brings its links. Other
    columns are ignored. An empty table gives an empty result.
    """
    sketches, classes, links = linked_classes(_keyed(docs), width, percent)
    member = sketches.where("same is not null and doc_id is not null").select("doc_id", "same").distinct()
    shared = member.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
    shared = cut(member.join(shared, "doc_id").join(classes.select("same", "node"), "same").select("doc_id", "node"), "shared")
    if not shared.isEmpty():  # rows of one doc_id are chained, so that no doc_id is gathered in one task
        hub = shared.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.union(shared.join(hub, "doc_id").where("a != node").select("a", F.col("node").alias("b")))
    label = connected_components(links)
    named = label.join(classes, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = label.join(named, "component").select("node", "component_id")
    of_class = cut(classes.join(of_class, "node", "left").select("same", F.coalesce("component_id", "doc_id").alias("component_id"), "copies"), "groups")
    linked = split_join(sketches.where("same is not null and doc_id is not null"), of_class, ["same"], "copies")
    alone = sketches.where("same is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` with all columns, one of each group of near copies: the first by doc_id and text hash.

    Groups are of texts, so rows that share a doc_id but not a text are judged each. Rows equal in doc_id and text are
    copies, of which one stays. Rows without words or with a null doc_id stay. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    sketches, classes, links = linked_classes(keyed, width, percent)
    label = connected_components(links)
    of_class = cut(classes.join(label, "node", "left").select("same", "doc_id", "key", F.coalesce("component", "node").alias("component")), "groups")
    first = of_class.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.doc_id", "first.key")
    rows = sketches.where("same is not null and doc_id is not null").groupBy("doc_id", "key").agg(F.count("*").alias("rows"))
    gone = cut(rows.select("doc_id", "key").join(first, ["doc_id", "key"], "left_anti").withColumnsRenamed({"doc_id": "gone_id", "key": "gone_key"}), "gone")
    twice = cut(rows.where("rows > 1").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")), "twice")
    same = lambda ids: (docs["doc_id"].cast("long") == ids["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == ids["gone_key"])
    out = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return out
    again = out.join(twice, same(twice), "left_semi").withColumn("twice_key", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "twice_key"]).drop("twice_key")
    return out.join(twice, same(twice), "left_anti").unionByName(again)

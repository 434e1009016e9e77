import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import first_seen, interpolation, queries, vector_codes

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# first-seen lines


def plain_lines(docs, batches, least):
    """Documents (text, batch) without seen lines, and the keys that lost some."""
    held, out, lost = {}, {}, {}
    for b in range(batches):
        mine = [(i, t or "") for i, (t, k) in enumerate(docs) if k == b]
        earlier = dict(held)
        for i, t in mine:
            lines, kept = t.split("\n"), []
            for x in lines:
                key = lowered(x.strip(BLANKS))
                if key and earlier.get(key, 0) >= least:
                    first, n = lost.get(key, (b, 0))
                    lost[key] = (first, n + 1)
                else:
                    kept.append(x)
            out[i] = (b, "\n".join(kept), len(lines), len(lines) - len(kept))
            for key in {lowered(x.strip(BLANKS)) for x in lines} - {""}:
                held[key] = held.get(key, 0) + 1
    return out, {hashlib.sha256(k.encode()).hexdigest(): (f, held[k], n) for k, (f, n) in lost.items()}


def test_lines_equal_a_plain_count(spark):
    rng = np.random.default_rng(4)
    common = ["Cookie banner", "  cookie BANNER\t", "licence", "ÄÖ kept case", "äö kept case", "", " \x0b", "a\xa0", "hot"]
    docs = [("\n".join([*rng.choice(common, int(rng.integers(0, 7))), f"own {i}"][:: int(rng.choice([1, -1]))]), int(rng.integers(0, 4))) for i in range(150)]
    docs += [(None, 0), ("", 1), ("hot\nhot\n\n", 3), ("x\r\ny\n", 2), ("licence\n" * 3000, 3)] + [("hot\nsame", 2)] * 40
    rows = spark.createDataFrame([(None if i % 50 == 7 else i // 2, t, b, "k", [1]) for i, (t, b) in enumerate(docs)], "doc_id long, text string, b int, key string, gone array<int>")
    cleaned, lines = first_seen.strip_seen_lines(rows, F.col("b"), 5, least_docs=3)
    want, lost = plain_lines(docs, 5, 3)
    key = lambda i, v: (None if i % 50 == 7 else i // 2, *v)
    assert sorted(map(str, (tuple(r) for r in cleaned.select("doc_id", "batch", "text", "n_all", "n_removed").collect()))) == sorted(str(key(i, v)) for i, v in want.items())
    assert {r.key_sha256: (r.batch, r.n_docs, r.n_removed) for r in lines.collect()} == lost


def test_no_documents_and_empty_batches(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    cleaned, lines = first_seen.strip_seen_lines(none, F.lit(0), 2)
    assert cleaned.count() == 0 and lines.count() == 0
    one = spark.createDataFrame([(1, "a b\na b"), (2, "a b")], "doc_id long, text string")
    cleaned, lines = first_seen.strip_seen_lines(one, F.col("doc_id"), 4, least_docs=1, least_chars=3)
    assert {(r.doc_id, r.text, r.n_removed) for r in cleaned.collect()} == {(1, "a b\na b", 0), (2, "", 1)} and [(r.batch, r.n_docs, r.n_removed) for r in lines.collect()] == [(2, 2, 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


# vector codes


def plain_codes(rows, entries, rounds, parts):
    kept = [(i, [math.floor(256 * max(min(x, vector_codes.BOUND), -vector_codes.BOUND)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    d = width // parts
    kept = [(i, v + [0] * (width - len(v)), g) for i, v, g in kept]
    first = [v for _, v, _ in sorted(((i, v, 0) for i, v, _ in kept if i is not None))[:entries]]
    books = [[v[p * d : (p + 1) * d] for v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                x = v[p * d : (p + 1) * d]
                groups.setdefault(near(x, books[p])[1], []).append(x)
            for j, xs in groups.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, g in kept:
        found = [near(v[p * d : (p + 1) * d], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found), g))
    total = {}
    for _, _, e, g in out:
        total[g] = total.get(g, 0) + e
    return sorted(map(str, ((i, c, e, total[g], digest) for i, c, e, g in out)))


@pytest.mark.parametrize("entries", [3, 20])
def test_codes_equal_a_plain_search(spark, entries):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 12) / 256], "hot" if i % 3 else (None if i % 2 else f"g{i % 5}")) for i in range(120)]
    rows += rows[:4] + [(5, [0.5] * 12, "x"), (None, [0.1] * 12, ""), (300, None, "x"), (301, [None] * 12, "x"), (302, [float("nan")] + [0.0] * 11, "x"), (303, [float("inf")] * 12, "x"), (304, [], "x"), (305, [1.0] * 5, "x"), (306, [1e30, -1e30] + [0.0] * 10, "x")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label string, code string, n int")
    got = vector_codes.compress(df, parts=4, entries=entries).drop("label")
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_codes(rows, entries, 2, 4)


def test_partial_distances_find_the_nearest(spark):
    rng = np.random.default_rng(1)
    for dims, scale in ((1, 3), (4, 2), (7, 1000)):
        x, book = rng.integers(-scale, scale, (500, dims)), rng.integers(-scale, scale, (64, dims))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, error = vector_codes.nearest(x, book)
        assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_codes_of_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(none).count() == 0 and vector_codes.compress(none.limit(0)).count() == 0


# deleted interpolation


def tokens(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text or "")) + ["</s>"]


def plain_counts(texts, order):
    counts = {}
    for t in texts:
        seq = ["<s>"] * (order - 1) + tokens(t)
        for i in range(len(seq)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    g = tuple(seq[i - k + 1 : i + 1])
                    counts[g] = counts.get(g, 0) + 1
    return counts


def plain_score(text, counts, weights, order):
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",))
    v = sum(1 for g in counts if len(g) == 1 and g != ("<s>",))
    seq = ["<s>"] * (order - 1) + tokens(text)
    total = base = 0.0
    for i in range(order - 1, len(seq)):
        parts, context = [1 / (v + 1)], n
        held = 0
        for k in range(1, order + 1):
            c = n if k == 1 else counts.get(tuple(seq[i - k + 1 : i]), 0)
            if not c:
                break
            held, context = k, c
            parts.append(counts.get(tuple(seq[i - k + 1 : i + 1]), 0) / c)
        bucket = held if held <= 1 else held * 64 + int(math.log2(context))
        w = weights.get(bucket) if bucket else None
        w = weights[-held] if w is None else w
        total += math.log10(sum(a * b for a, b in zip(w, parts, strict=True)))
        base += math.log10((counts.get((seq[i],), 0) + 1) / (n + v + 1))
    return total, base


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_mixture(spark, monkeypatch, order):
    rng = np.random.default_rng(order)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 30)), p=np.arange(30, 0, -1) / 465)) for _ in range(120)]
    texts += ["The the THE\x0bthe", "", None, "ünï Ünï", "never seen words", "hot " * 4000] + ["the same"] * 20
    rows = [(None if i == 5 else i // 2 * 2, t) for i, t in enumerate(texts)]
    kept = {}
    learn = interpolation.learn
    monkeypatch.setattr(interpolation, "learn", lambda cells, o: kept.setdefault("w", learn(cells, o)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = interpolation.score(df, F.col("doc_id") % 6 != 4, order)
    counts = plain_counts([t for i, t in rows if i is not None and i % 6 != 4], order)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect())
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",))
    want = []
    for i, t in rows:
        score, base = plain_score(t, counts, kept["w"], order)
        want.append((-1 if i is None else i, len(tokens(t)), sum((x,) in counts for x in tokens(t)), n, round(base, 6), round(score, 6)))
    assert [x[:4] for x in found] == [x[:4] for x in sorted(want)]
    assert np.allclose([x[4:] for x in found], [x[4:] for x in sorted(want)], atol=2e-5)
    for b, w in kept["w"].items():
        assert len(w) == (interpolation.orders_in(b) if b > 0 else -b) + 1 and abs(w.sum() - 1) < 1e-9 and (w > 0).all()


def test_weights_climb_to_the_likeliest():
    cells = [(65 + 64, [interpolation._NEVER, 20], 70), (65 + 64, [8, interpolation._NEVER], 20), (65 + 64, [interpolation._NEVER, interpolation._NEVER], 10)]
    w = interpolation.learn(cells, 2)[129]
    assert w[2] > w[1] > w[0] > 0 and abs(w.sum() - 1) < 1e-9


def test_learning_from_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = interpolation.score(df, F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert interpolation.score(df.limit(0), F.lit(True)).count() == 0
    assert interpolation.score(df, F.lit(None).cast("boolean")).count() == 2


def test_held_out_documents_are_likelier_than_by_unigrams(spark):
    out = queries.op13_deleted_interpolation(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lessons = {i: t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    assert {r.doc_id for r in out} == set(docs) and {r.train_tokens for r in out} == {sum(len(tokens(t)) for t in lessons.values())}
    assert all(r.held_out == (r.doc_id not in lessons) and r.n_tokens == len(tokens(docs[r.doc_id])) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_packed_numbers_come_back():
    for a in (np.zeros(0, np.uint64), np.array([0, 255, 256], np.uint64), np.sort(np.random.default_rng(0).integers(0, 2**63, 999).astype(np.uint64))):
        assert (interpolation.unpack(interpolation.pack(a)) == a).all() and (interpolation.unpack_sorted(interpolation.pack_sorted(a)) == a).all()


def test_all_groups_of_copies_count_once_whatever_their_number(spark):
    from folioforge.llm import perplexity

    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(text(i), "en", 10 * i + c, 1) for i in range(30) for c in range(1 + i % 3)] + [("few words", "en", 900, 1), ("few words", "en", 901, 1), ("", "en", 902, 1)]
    docs = spark.createDataFrame(rows, "text string, lang string, id long, model long").withColumn("doc_id", F.col("id"))
    counts = lambda d, most: {r.key: r.n for r in perplexity.count_grams(d, most).collect()}
    want = counts(docs.where("id % 10 = 0 or id >= 900"), 1000)
    assert counts(docs, 1000) == want == counts(docs, 3)

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import attention_mil, bpe, cdc_dedup, chat_events, collision_lsh, langid_cnn, perplexity, queries, setsketch, skew, soft_mixing, warc_revisit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, node string, n string, key int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randint(1, 8))) for _ in range(n))


def odd_docs():
    """Null and empty texts, one very long, copies, near copies, repeated rows, null keys; columns with clashing names."""
    rnd = random.Random(1)
    base = words(rnd, 200)
    texts = [base, base, base.replace(" a", " b", 1), words(rnd, 40), "", None, "x", "x", "one two three", "ONE two  three", words(rnd, 30_000), "\n\n", "日本語 テキスト"]
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rnd.randrange(len(w))] = "new"
        texts.append(" ".join(w))
    rows = [(i, t, "en" if i % 2 else None, "node", "n", i) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, "en", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in nodes}


def test_near_duplicates_equal_brute_force(docs, none):
    rows = {r[0]: r[1] for r in odd_docs() if r[0] is not None}
    sets = {i: shingles(t) for i, t in rows.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    want = components(sets, links)
    got = setsketch.near_duplicates(docs).collect()
    assert len(got) == len(odd_docs())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), r.doc_id == want[r.doc_id])
    assert setsketch.near_duplicates(none).count() == 0


def test_group_of_near_copies_with_few_common_neighbours(spark):
    rnd = random.Random(8)
    rows = []
    for g in range(4):
        base = words(rnd, 120).split()
        for k in range(40):
            w = list(base)
            for _ in range(rnd.randint(0, 9)):
                w[rnd.randrange(len(w))] = words(rnd, 1)
            rows.append((g * 100 + k, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def repeated_ids():
    rnd = random.Random(41)
    x, y, z = (words(rnd, 200) for _ in range(3))
    rows = [(1, x), (1, y), (2, x + " more"), (3, y + " other"), (4, z), (4, z), (5, z), (6, ""), (6, z + " end"), (6, words(rnd, 50)), (7, None), (7, words(rnd, 9)), (None, x)]
    return rows + [(rnd.randint(8, 30), " ".join(w if rnd.random() > 0.01 else "new" for w in rnd.choice([x, y, z]).split())) for _ in range(60)]


def test_near_duplicates_with_repeated_ids_equal_brute_force(spark):
    rows = repeated_ids()
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and near(a, b)]
    want = components({i for i, _ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a, b in linked])
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, node int").repartition(4)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in setsketch.near_duplicates(df).collect())
    own = [want.get(i, -1) if s else i or -1 for (i, _), s in zip(rows, sets, strict=True)]  # a row without words stands alone
    assert got == sorted((i or -1, len(s), c, i is None or i == c) for (i, _), s, c in zip(rows, sets, own, strict=True))
    # one row of each group of texts stays, judged by the texts alone
    key = {r.node: r.k for r in df.select("node", F.xxhash64("text").alias("k")).collect()}
    group = components(range(len(rows)), linked)
    kept = {min((rows[k][0], key[k]) for k in group if group[k] == g) for g in set(group.values()) if sets[g] and rows[g][0] is not None}
    out = setsketch.drop_near_duplicates(df).collect()
    assert all(r.node is not None and rows[r.node] == (r.doc_id, r.text) for r in out)
    assert sorted((r.doc_id, key[r.node]) for r in out if r.doc_id is not None and sets[r.node]) == sorted(kept)
    assert sorted(r.node for r in out if r.doc_id is None or not sets[r.node]) == [k for k, (i, _) in enumerate(rows) if i is None or not sets[k]]


def test_mixed_buckets_deal_the_large_side_once(spark, monkeypatch):
    rnd = random.Random(9)
    base = words(rnd, 100).split()
    half = base[:50] + words(rnd, 50).split()
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(200)] + [(1000 + k, " ".join([*half, *words(rnd, 3).split()])) for k in range(12)]
    monkeypatch.setattr(setsketch, "BLOCK", 32)
    dealt, plain = [], setsketch._mixed
    monkeypatch.setattr(setsketch, "_mixed", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(200)} == {0} and {got[1000 + k] for k in range(12)} == {1000}
    sizes = [r for d in dealt for r in d.groupBy("key").agg(F.countDistinct("node").alias("n"), F.count("*").alias("rows")).collect()]
    assert all(r.rows <= r.n + 12 * (-(-r.n // 32) + 2) for r in sizes)


def test_registers_merge_and_estimate():
    rnd = np.random.default_rng(1)
    a, b = (np.unique(rnd.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    assert (setsketch.merge(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(np.union1d(a, b))).all()
    near = np.concatenate([a[:460], b[:40]])
    ra, rn, rb = (setsketch.registers(x)[None] for x in (a, near, b))
    assert setsketch.passes(ra, rn, [500], [500], 0.75)[0] and not setsketch.passes(ra, rb, [500], [500], 0.75)[0]


def base_counts(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    held = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(held)


def test_base_counts_equal_brute_force(docs, none, spark):
    rnd = random.Random(4)
    extra = [(100 + i, "\n".join(rnd.choice(["a b", " a b", "", "x#y|<>", "one two three four five six seven eight"]) for _ in range(rnd.randint(0, 30))), "en") for i in range(60)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    text = {r.doc_id: r.text for r in both.collect()}
    for r in perplexity.quality_rules(both).collect():
        n = base_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    assert perplexity.quality_rules(none).count() == 0


class PlainKneserNey:
    """Modified Kneser-Ney by dictionaries: the last order counts documents, lower ones count what stands before; single high grams are not stored."""

    def __init__(self, texts):
        top, low, stored = perplexity.ORDER, perplexity.LOW, perplexity.STORED
        self.count = {top: defaultdict(int)}
        for t in texts:
            padded = bytes(top - 1) + t
            for g in {padded[i : i + top] for i in range(len(t))}:
                self.count[top][g] += 1
        for k in range(top - 1, 0, -1):
            self.count[k] = defaultdict(int)
            for g in self.count[k + 1]:
                self.count[k][g[1:]] += 1
        self.weight, self.main = {}, {}
        for k in range(1, top + 1):
            c = self.count[k]
            d = perplexity._discounts(np.array([sum(v == x for v in c.values()) for x in (1, 2, 3, 4)]))
            total, gone = defaultdict(int), defaultdict(float)
            for g, v in c.items():
                total[g[:-1]] += v
                gone[g[:-1]] += d[min(v, 3)] if k <= low or v >= stored else v
            for x in total:
                self.weight[x] = gone[x] / total[x]
            for g, v in c.items():
                self.main[g] = (v - d[min(v, 3)]) / total[g[:-1]] if k <= low or v >= stored else 0.0

    def p(self, g):
        if not g:
            return 1 / 256
        return self.main.get(g, 0.0) + self.weight.get(g[:-1], 1.0) * self.p(g[1:])


def kneser_ney_texts():
    rnd = random.Random(17)
    vocabulary = [words(rnd, 1) for _ in range(25)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))) for _ in range(40)] + ["a", "", "\n\n", "zq"]


@pytest.mark.parametrize("shard", [8_000_000, 700])
def test_perplexity_equals_plain_kneser_ney(spark, monkeypatch, shard):
    monkeypatch.setattr(perplexity, "SHARD", shard)
    texts = kneser_ney_texts()
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, t[::-1], "xx") for i, t in enumerate(texts)] + [(500, texts[0], "en"), (500, texts[0], "en"), (501, None, None)]
    plain = {x: PlainKneserNey([(t or "").encode() for i, t, y in rows if y == x and i < 500]) for x in ("en", "xx")}
    seen = []
    keep = perplexity._score
    monkeypatch.setattr(perplexity, "_score", lambda m, x, n: seen.append(n) or keep(m, x, n))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = perplexity.score_documents(df).collect()
    assert len(got) == len(rows) and (seen[0] > 2) == (shard == 700)
    # copies of eight words and more count once; shorter ones, as here, each
    counted = [t for i, t, y in rows if y == "en"]
    once = [t for k, t in enumerate(counted) if len(t.split()) < 8 or t not in counted[:k]]
    plain["en"] = PlainKneserNey([t.encode() for t in once])
    for r in got:
        t = next(t for i, t, _ in rows if i == r.doc_id) or ""
        raw = bytes(perplexity.ORDER - 1) + t.encode()
        want = [-np.log(plain[r.lang].p(raw[i : i + perplexity.ORDER])) for i in range(len(t.encode()))] if t else [0.0]
        assert abs(r.log_ppl - np.mean(want)) < 2e-4, (r, np.mean(want))


def test_kneser_ney_sums_to_one_and_the_model_grows():
    texts = [t.encode() for t in kneser_ney_texts()]

    def parts(texts):
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        key, n = np.unique(perplexity.grams(np.frombuffer(b"".join(texts), np.uint8), off, np.ones(len(texts), int)), return_counts=True)
        tables = {perplexity.ORDER: (key, n)}
        for k in range(perplexity.ORDER - 1, perplexity.LOW - 1, -1):
            g = tables[k + 1][0]
            tables[k] = np.unique((g >> 8 * (k + 1)) << 8 * k | g & ((1 << 8 * k) - 1), return_counts=True)
        discounts = {k: np.array([np.zeros(4), perplexity._discounts(np.bincount(np.minimum(tables[k][1], 5), minlength=6)[1:5])]) for k in range(perplexity.LOW + 1, perplexity.ORDER + 1)}
        low, entries = perplexity.fit_low(*tables[perplexity.LOW], 2)
        high = perplexity.fit_high(key, n, low, discounts)
        return key, perplexity.Model(np.concatenate([entries[0], high[0]]), np.concatenate([entries[1], high[1]]))

    key, model = parts(texts)
    for context in (int(key[len(key) // 2]) & ~255, int(key[0]) & ~255, (1 << 48) | int.from_bytes(b"\x07xyz ", "big") << 8):
        p = np.exp(model.log_probability(context + np.arange(256)))
        assert abs(p.sum() - 1) < 1e-5 and (p > 0).all()
    assert len(model.keys) > 1.5 * len(parts(texts[:10])[1].keys)


def test_bands_reject_most_bad_documents_and_keep_good_ones(spark):
    sf = "/root/testdata/sf0.1"
    out = perplexity.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert out[out.quality == 0].kept.mean() < 0.25 and out[out.quality == 1].kept.mean() > 0.95
    assert (out.high > out.low).all()


def test_bands_hold_for_copies_near_copies_and_small_languages(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("bdklmnrst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(60)]
    clean = lambda: " ".join(rnd.choice(vocabulary) for _ in range(120))
    soup = lambda: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0A#~;.,!") for _ in range(6)) for _ in range(60))
    base = clean().split()
    near = lambda k: " ".join([*base, *(["x"] * 3), f"end{k}"])
    texts = {"copies": [clean() for _ in range(60)] + [" ".join(base)] * 120, "near": [clean() for _ in range(60)] + [near(k) for k in range(120)], "small": [clean() for _ in range(15)]}
    rows = [(x, t, False) for x, ts in texts.items() for t in ts] + [(x, soup(), True) for x in texts]
    df = spark.createDataFrame([(i, t, x) for i, (x, t, _) in enumerate(rows)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in perplexity.quality_rules(df).collect()}
    assert all(not out[i].kept and not out[i].base_failed for i, r in enumerate(rows) if r[2])
    for x in texts:
        assert np.mean([out[i].kept for i, r in enumerate(rows) if r[0] == x and not r[2]]) > 0.9, x


def labelled(spark):
    rnd = random.Random(2)
    good = [(i, words(rnd, rnd.randint(30, 200)), 1) for i in range(120)]
    bad = [(200 + i, " ".join(w + rnd.choice(["$$$", "###", "!!"]) for w in words(rnd, rnd.randint(30, 200)).split()), 0) for i in range(60)]
    return spark.createDataFrame(good + bad, "doc_id long, text string, label int")


def test_attention_learns_and_scores_odd_rows(spark, docs, none):
    rows = labelled(spark)
    net = attention_mil.train(rows.where("doc_id % 3 != 1").select("doc_id", "text"), rows.select("doc_id", "label"))
    got = attention_mil.score(rows, net).join(rows, "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([(r.score >= 0.5) == (r.label == 1) for r in got]) > 0.95
    odd = attention_mil.score(docs, net).collect()
    assert len(odd) == len(odd_docs()) and all(0 <= r.score <= 1 for r in odd)
    assert attention_mil.score(none, net).count() == 0 and attention_mil.train(none, rows.select("doc_id", "label")) is None
    assert all(r.score == 0.5 for r in attention_mil.score(docs, None).collect())


def test_attention_gradient_is_right():
    rng = np.random.default_rng(0)
    x, first, label, weight = rng.normal(size=(7, 5)), np.array([0, 3, 7]), np.array([0, 1]), np.array([0.7, 1.3])
    net = attention_mil.start(x)

    def loss():
        p = net.scores(x, first)
        return -(weight * np.where(label == 1, np.log(p), np.log(1 - p))).sum()

    for name, g in attention_mil.gradients(net, x, first, label, weight).items():
        w = net.weights[name].reshape(-1)
        for k in rng.integers(0, len(w), 6).tolist():
            was, ends = w[k], []
            for step in (1e-5, -1e-5):
                w[k] = was + step
                ends.append(loss())
            w[k] = was
            assert abs((ends[0] - ends[1]) / 2e-5 - g.reshape(-1)[k]) < 1e-6, name
    net = attention_mil.fit(x, first, label)
    o = net.forward(x, first)
    assert np.allclose(np.add.reduceat(o["att"], first[:-1]), 1) and (o["p"] > 0.5).tolist() == [False, True]


def test_fits_take_bounded_samples_of_repeated_ids(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(7, words(rnd, 30), "en") for _ in range(3000)] + [(8, "same text again and again", "de")] * 3000
    rows += [(100 + i, words(rnd, 5000 if i < 3 else 20), "fr") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    taken = {}
    monkeypatch.setattr(langid_cnn, "fit", lambda x, y, langs: taken.update(windows=len(x), langs=langs, each=np.bincount(y)))
    langid_cnn.train(docs)
    assert taken["langs"] == ["de", "en", "fr"] and taken["each"][0] == 1 and 250 * 1 <= taken["each"][1] <= 400 * 6
    monkeypatch.setattr(langid_cnn, "FIT_ROWS", 30)
    langid_cnn.train(docs)
    assert taken["langs"] == ["de", "en", "fr"] and taken["each"][1] <= 10 * 6 and 10 <= taken["each"][2] <= 10 * 6
    monkeypatch.setattr(attention_mil, "FIT_DOCS", 500)
    monkeypatch.setattr(attention_mil, "fit", lambda x, first, label: taken.update(bags=label, size=np.diff(first)))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0)] + [(100 + i, i % 2) for i in range(30)], "doc_id long, label int")
    attention_mil.train(docs, labels)
    assert len(taken["bags"]) == 500 and taken["size"].max() <= attention_mil.FIT_PASSAGES and set(taken["bags"]) == {0, 1}
    monkeypatch.setattr(attention_mil, "FIT_DOCS", 5000)
    attention_mil.train(docs, labels)
    assert len(taken["bags"]) == 3000 + 1 + 30 and taken["size"].max() == attention_mil.FIT_PASSAGES


def test_langid(spark, docs, none):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["the", "and", "thing", "over"]) for _ in range(rnd.randint(3, 90))), "en") for i in range(60)]
    rows += [(100 + i, " ".join(rnd.choice(["der", "und", "schön", "über"]) for _ in range(rnd.randint(3, 90))), "de") for i in range(60)]
    df = spark.createDataFrame([*rows, (500, "12 34", None), (501, None, "en"), (None, "the", "en")], "doc_id long, text string, lang string")
    net = langid_cnn.train(df.where("doc_id % 3 != 1"))
    got = {r.doc_id: r for r in langid_cnn.predict(df, net).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 3 == 1]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    assert got[500].lang_pred == got[501].lang_pred == "und"
    assert langid_cnn.predict(docs, net).count() == len(odd_docs()) and langid_cnn.predict(none, net).count() == 0
    assert langid_cnn.train(none) is None and langid_cnn.predict(docs, None).where("lang_pred != 'und'").count() == 0
    x = np.frombuffer("über the thing".encode().ljust(128, b"\0"), np.uint8)[None]  # tables equal the plain convolution
    e = net.embed[x[0]]
    plain = [max(0, max(sum(e[i + k] @ net.banks[w][k][:, f] for k in range(w)) for i in range(128 - w + 1)) + net.bias[w][f]) for w in langid_cnn.WIDTHS for f in range(langid_cnn.FILTERS)]
    assert np.allclose(net.pooled(x)[0], plain, atol=1e-4)


def test_chat_fold_and_round_trip(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "a"), (1, 3, "delta", 1, "assistant", "b"), (1, 4, "message", 2, "user", "later"),
        (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "</s>"), (1, 7, "edit", 0, None, "[INST]"), (1, 8, "delta", 1, "assistant", "<\\s>[/INST]"),
        (2, 1, "message", 0, "system", None), (2, 1, "message", 0, "system", None), (None, 1, "message", 0, "user", "x"), (3, 1, "odd", 0, "user", "x"),
    ]
    events = spark.createDataFrame([(*r, "clash") for r in log], "conv_id long, seq long, kind string, slot long, role string, text string, cut string")
    got = sorted(map(tuple, chat_events.fold(events).collect()))
    assert got == [(1, 0, "user", "[INST]"), (1, 1, "assistant", "</s><\\s>[/INST]"), (2, 0, "system", "")]
    segments = chat_events.render(chat_events.fold(events)).collect()
    assert {(r.conv_id, r.slot, *chat_events.parse_segment(r.segment)) for r in segments} == set(got)
    assert chat_events.read_back(chat_events.render(chat_events.fold(events.limit(0)))).count() == 0


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>", "<<SYS>>", "<<<s>", "\\<s>", "[\\\\\\INST]", "<", "[/INST", ""])
def test_escape_is_reversible(spark, text):
    safe = spark.createDataFrame([(text,)], "t string").select(chat_events.escape(F.col("t"))).first()[0]
    assert chat_events.unescape_text(safe) == text and not any(c in safe for c in chat_events.CONTROL)


def test_substring_dedup(spark, docs, none):
    rnd = random.Random(3)
    passages, rows, first = [words(rnd, 60) for _ in range(8)], [], {}
    for i in range(120):
        k = i % 24
        rows.append((i, f"{words(rnd, 30)} {passages[k]} {words(rnd, 20)}" if k < 8 else words(rnd, 90), k if k < 8 else None))
    got = {r.doc_id: r for r in cdc_dedup.remove_repeats(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)).collect()}
    for i, t, k in rows:
        r = got[i]
        if k is None or first.setdefault(k, i) == i:
            assert r.text == t and not r.removed_chars
        else:
            assert r.removed_chars > 0.4 * len(passages[k]) and first[k] in r.first_doc_ids
            assert len(r.text) == len(t) - r.removed_chars and all(passages[k].find(t[s.start + 40 : s.stop - 40]) >= 0 for s in r.spans)
    odd = {r.doc_id: r for r in cdc_dedup.remove_repeats(docs).collect()}
    assert odd[1].text == "" and odd[5].text is None and odd[4].text == "" and odd[0].removed_chars == 0 and odd[10].removed_chars == 0
    assert odd[None].removed_chars == 0 and cdc_dedup.remove_repeats(none).count() == 0


def repeats_brute_force(rows, min_words=cdc_dedup.MIN_WORDS):
    """Texts after removal, row by row, from the chunks of each text and one dictionary of their first places."""
    def pieces(text):
        raw = (text or "").encode()
        begin, _ = cdc_dedup.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [raw[a:b] for a, b in zip(begin, [*begin[1:], len(raw)][: len(begin)], strict=True)]

    key = {t: k for t, k in rows}
    first = {}
    for i, t in sorted({(i, t) for i, t in key if i is not None and t}, key=lambda x: (x[0], key[x])):
        for at, p in enumerate(pieces(t)):
            first.setdefault(p, (i, t, at))
    out = []
    for i, t in [x for x, _ in rows]:
        if i is None or not t:
            out.append((i, t))
            continue
        cut_, kept, run = pieces(t), [], []
        text = b"".join(cut_)
        starts = np.cumsum([0, *map(len, cut_)])
        begins = [m.start() for m in re.finditer(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", text)]
        for at, p in [*enumerate(cut_), (len(cut_), None)]:
            if p is not None and first[p] != (i, t, at):
                run.append((at, p))
                continue
            n = sum(starts[run[0][0]] <= b < starts[run[-1][0] + 1] for b in begins) if run else 0
            kept += [] if n >= min_words else [q for _, q in run]
            run = []
            if p is not None:
                kept.append(p)
        out.append((i, b"".join(kept).decode()))
    return out


def test_substring_dedup_equals_brute_force_with_repeated_ids(spark, monkeypatch):
    rnd = random.Random(31)
    passages = [words(rnd, 60) for _ in range(6)]
    rows = [(1, words(rnd, 30) + " " + passages[0]), (2, words(rnd, 30) + " " + passages[0] + " " + words(rnd, 30)), (2, words(rnd, 90)), (2, words(rnd, 200))]
    rows += [(rnd.randint(3, 40), " ".join([words(rnd, rnd.randint(0, 40)), *rnd.sample(passages, rnd.randint(0, 3)), words(rnd, 15)])) for _ in range(120)]
    rows += [rows[5], rows[5], (None, passages[1]), (50, None), (51, ""), (52, passages[2] * 3)]
    df = spark.createDataFrame([(*r, f"x{k}", k) for k, r in enumerate(rows)], "doc_id long, text string, note string, digest int").repartition(4)
    keys = {r.note: r.k for r in df.select("note", F.xxhash64("text").alias("k")).collect()}
    want = repeats_brute_force([(r, keys[f"x{k}"]) for k, r in enumerate(rows)])
    for most in (1 << 16, 2):
        monkeypatch.setattr(cdc_dedup, "split_join", lambda *a: skew.split_join(*a, least=4, most=most))  # noqa: B023
        got = cdc_dedup.remove_repeats(df, keep=("note", "digest")).collect()
        assert {r.note: (r.doc_id, r.text) for r in got} == {f"x{k}": r for k, r in enumerate(want)} and len(got) == len(rows)
    assert sum(len(t or "") for _, t in want) < sum(len(t or "") for _, t in rows)
    out = {r.note: r for r in got}
    assert out["x2"].text == rows[2][1] and out["x3"].text == rows[3][1] and out["x2"].n_repeats == 0 and out["x1"].removed_chars > 100


def test_chunks_cover_texts_and_survive_insertions():
    text = words(random.Random(9), 400)
    found = []
    for raw in (text.encode(), f"{text[:300]} inserted {text[300:]}".encode(), b"", "é".encode() * 3000, b"x" * 5000):
        begin, _ = cdc_dedup.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        ends = [*begin[1:], len(raw)][: len(begin)]
        found.append([raw[i:j] for i, j in zip(begin, ends, strict=True)])
        assert b"".join(found[-1]) == raw and all(p.decode() for p in found[-1])
    assert len(set(found[0]) & set(found[1])) > 0.9 * len(set(found[0]))


def test_revisits(spark):
    h = [("ETag", '"a"'), ("Server", "s")]
    rows = [
        (1, 10, "http://WWW.a.com:80/x?b=2&a=1#f", "response", '"a"', None, None, h, "body1"), (2, 200_000, "https://a.com/x?a=1&b=2", "response", '"b"', None, None, h, "body2"),
        (3, 199_999, "http://a.com/x?a=1&b=2", "revisit", 'W/"a"', None, None, [("etag", '"n"'), ("X", "y")], None), (4, 300_000, "http://a.com/x?a=1&b=2", "revisit", '"a"', None, None, None, None),
        (5, 5, "http://a.com/x?a=1&b=2", "revisit", '"a"', None, None, None, None), (6, 200_001, "http://a.com/x?a=1&b=2", "revisit", None, "d", None, None, None),
        (7, 200_000, "http://a.com/x?a=1&b=2", "revisit", '"a"', None, None, None, None), (8, 20, None, "revisit", '"a"', None, None, None, None), (9, None, None, None, None, None, None, None, None),
    ]
    kind = "record_id long, ts long, url string, kind string, etag string, last_modified string, digest string, headers array<struct<name: string, value: string>>, payload string"
    got = {r.record_id: r for r in warc_revisit.resolve_revisits(spark.createDataFrame(rows, kind).withColumn("ref", F.lit(0)).withColumn("bucket", F.lit(0))).collect()}
    assert {k: (r.state, r.ref_record_id) for k, r in got.items()} == {
        1: ("full", None), 2: ("full", None), 3: ("resolved", 1), 4: ("validator_mismatch", 2), 5: ("no_response", None), 6: ("no_validator", 2), 7: ("resolved", 1), 8: ("no_response", None), 9: ("no_response", None),
    }
    assert got[3].payload == "body1" and [tuple(x) for x in got[3].headers] == [("Server", "s"), ("etag", '"n"')]
    assert warc_revisit.resolve_revisits(spark.createDataFrame([], kind)).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark, docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(6)
    kinds = [(1, 127), (128, 0x7FF), (0x800, 0xD7FF), (0x10000, 0x1FFFF)]
    texts = ["", " ", "a" * 3000, "it's I'LL 12 ½", "՘x\U00019148멳", "\n \t\n x  y"] + ["".join(chr(rnd.randint(*rnd.choice(kinds))) for _ in range(120)) for _ in range(100)]
    codec = queries.vocabulary().codec()
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text) and codec.decode(ids) == text.encode()
    got = queries.tokenized(docs).collect()
    text = {r[0]: r[1] or "" for r in odd_docs()}
    assert len(got) == len(odd_docs()) and queries.tokenized(none).count() == 0
    for r in got:
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    coded = bpe.encode_documents(docs, queries.vocabulary())
    back = bpe.decode_documents(coded, queries.vocabulary()).collect()
    assert all(bytes(r.decoded).decode() == text[r.doc_id] for r in back)


def vector_rows(rng):
    centre = rng.normal(size=(6, 16))
    rows = [(i, (centre[i % 6] + 0.12 * rng.normal(size=16)).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [None] + [1.0] * 15, 0), (205, [float("nan")] * 16, 1), (206, rows[0][1], None), (207, [], 1), (208, [1e300] * 16, 1)]
    rows += [(3, (centre[4] + 0.05 * rng.normal(size=16)).tolist(), 0), (200, rows[0][1], 0), (209, [1.0, 2.0], 0), (210, [2.0, 4.1], 0), (211, [1.0], 0), (212, [3.0], 0), (213, [-1.0], 0)]
    return rows


def vector_brute_force(rows, threshold=0.93):
    """Links of each row and component of each vec_id; rows that share a vec_id share its component."""
    unit = {}
    for k, (_, v, lab) in enumerate(rows):
        if v and lab is not None and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, float) / np.abs(v).max()
            unit[k] = x / np.linalg.norm(x)
    linked = [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    degree = defaultdict(int)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    group = components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in linked])
    return sorted((r[0], degree[k], group[r[0]], r[0] == group[r[0]]) for k, r in enumerate(rows))


@pytest.mark.parametrize("block", [4096, 16])
@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_vectors_equal_brute_force(spark, monkeypatch, block, kind):
    rows = vector_rows(np.random.default_rng(3))
    name = {None: None, 0: 5, 1: 2**62 if kind == "long" else 6}
    rows = [(i, v, name[lab] if kind != "string" or lab is None else f"label {lab}") for i, v, lab in rows]
    df = spark.createDataFrame([(*r, 0) for r in rows], f"vec_id long, embedding array<double>, label {kind}, node int").repartition(3)
    monkeypatch.setattr(collision_lsh, "BLOCK", block)
    got = collision_lsh.near_duplicate_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == vector_brute_force(rows)
    assert collision_lsh.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_real_size_and_null_ids(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    near = base[rng.integers(0, 60, 500)] + 0.2 * rng.normal(size=(500, 64))  # cosines of about 0.96 and less
    rows = [(i, v, i % 3) for i, v in enumerate([*base.tolist(), *near.tolist()])]
    got = collision_lsh.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == vector_brute_force(rows)
    odd = collision_lsh.near_duplicate_vectors(spark.createDataFrame([(None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in odd} == {(None, 0, None, True), (1, 0, 1, True)}


@pytest.mark.parametrize("dim", [2, 16, 64, 256])
def test_the_count_is_calibrated(dim):
    least, found = collision_lsh.calibrated(dim, 0.93)
    assert least >= 1 and found > 0.998
    rng = np.random.default_rng(dim)
    value = np.sort(rng.normal(size=300))
    run = np.repeat([0, 1, 2], 100)
    value = np.concatenate([np.sort(rng.normal(size=100)) for _ in range(3)])
    got = {(int(i), int(j)) for a, b in collision_lsh.window_pairs(run, value, 0.4) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if run[i] == run[j] and value[j] - value[i] <= 0.4}


def test_mixing_meets_targets(spark, docs, none):
    rows = labelled(spark)
    labels = rows.select("doc_id", F.when(F.col("label") == 1, "good").otherwise("bad").alias("domain"))
    out = soft_mixing.mix(rows, labels.where("doc_id % 2 = 0"), {"good": 0.8, "bad": 0.2}).toPandas()
    got = np.array([(out.n_tokens * out[f"p_{d}"] * out.rate).sum() for d in ("good", "bad")])
    assert abs(got[0] / got.sum() - 0.8) < 0.01 and (out.rate >= 0).all() and (out.copies >= np.floor(out.rate)).all()
    right = labels.toPandas().set_index("doc_id").domain
    assert np.mean([(p > 0.5) == (right[i] == "good") for i, p in zip(out.doc_id, out.p_good, strict=True)]) > 0.95
    odd = soft_mixing.mix(docs, labels, {"good": 0.8, "bad": 0.2}, keep=("node", "key")).collect()
    assert sorted(str((r.doc_id, r.node, r.key)) for r in odd) == sorted(str((r[0], r[3], r[5])) for r in odd_docs())
    assert soft_mixing.mix(none, labels, {"good": 1.0}).count() == 0
    equal = soft_mixing.mix(rows, labels.limit(0), {"good": 0.8, "bad": 0.2}).collect()
    assert len(equal) == rows.count() and all(r.p_good == r.p_bad == 0.5 for r in equal)
    plan = soft_mixing.mix(rows, labels, {"good": 0.8, "bad": 0.2})._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_posteriors_tell_domains_by_few_words_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), queries.domains(spark.read.parquet(f"{sf}/labels.parquet"))
    half = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    out = soft_mixing.mix(documents, labels.where(~half), queries.WEIGHTS).join(labels.where(half), "doc_id").toPandas()
    for d in queries.WEIGHTS:
        mine = out[out.domain == d]
        assert (mine.n_tokens * mine[f"p_{d}"]).sum() / mine.n_tokens.sum() > 0.8, d


def test_odds_evidence_and_rates_equal_brute_force(spark):
    rows = labelled(spark)
    given = rows.toPandas()
    given["domain"] = np.where(given.label == 1, "good", "bad")
    known = spark.createDataFrame(given[given.doc_id % 2 == 0][["doc_id", "domain"]])
    domains = ["bad", "good"]
    text = soft_mixing._row_keys(rows, ())
    odds = soft_mixing.word_odds(text.select("doc_id", "text"), known, domains)
    distinct = {r.doc_id: set(re.split(r"[^a-zA-Zé]+", r.text.lower())) for r in given.itertuples()}
    here = given[given.doc_id % 2 == 0]
    n = {d: (here.domain == d).sum() for d in domains}
    hits = defaultdict(lambda: defaultdict(int))
    for r in here.itertuples():
        for w in distinct[r.doc_id]:
            if 2 <= len(w) <= 40:
                hits[w][r.domain] += 1
    want = {}
    for w, c in hits.items():
        if sum(c.values()) >= soft_mixing.LEAST_DOCS:
            o = [np.log((c[d] + 10 * n[d] / len(here)) / (sum(c.values()) + 10) / (n[d] / len(here))) for d in domains]
            o = [x if abs(x) >= 0.5 else 0.0 for x in o]
            if any(o):
                want[w] = o
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in want], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert {r.word: pytest.approx([r.w0, r.w1]) for r in odds.collect()} == {hashed[w]: o for w, o in want.items()}
    for r in soft_mixing.features(text, odds, 2).collect():
        mine = [want[w] for w in distinct[r.doc_id] if w in want]
        for i in (0, 1):
            assert r[f"e{i}s"] == pytest.approx(sum(o[i] for o in mine)) and r[f"e{i}m"] == pytest.approx(max([0.0, *(o[i] for o in mine)]))
    # the rates are a fixed point of the projected gradient: totals met, so no step is left
    out = soft_mixing.mix(rows, known, {"good": 0.7, "bad": 0.3}).toPandas()
    total = np.array([(out.n_tokens * out[f"p_{d}"] * out.rate).sum() for d in ("good", "bad")])
    keeps = (out.n_tokens * out.p_good).sum()
    assert np.allclose(total, [keeps, keeps * 3 / 7], rtol=1e-3) and out.rate.min() >= 0


def test_mixing_meets_the_weights_of_a_scarce_domain(spark):
    rows = labelled(spark)
    labels = rows.select("doc_id", F.when(F.col("label") == 1, "good").otherwise("bad").alias("domain"))
    few = rows.where("label = 1 or doc_id % 10 = 0")
    out = soft_mixing.mix(few, labels, {"good": 0.6, "bad": 0.4}).toPandas()
    for by, slack in (("rate", 0.01), ("copies", 0.05)):
        got = np.array([(out.n_tokens * out[f"p_{d}"] * out[by]).sum() for d in ("good", "bad")])
        assert abs(got[0] / got.sum() - 0.6) < slack, by
    assert out.copies.max() > 1
    once = soft_mixing.mix(few, labels, {"good": 0.6, "bad": 0.4}, max_epochs=1.0).toPandas()
    got = np.array([(once.n_tokens * once[f"p_{d}"] * once.rate).sum() for d in ("good", "bad")])
    assert abs(got[0] / got.sum() - 0.6) < 0.01 and once.rate.max() < 1.1
    scarce = soft_mixing.mix(few, labels, {"good": 0.6, "bad": 0.4}, most_epochs=4.0).toPandas()
    sure = scarce[scarce.p_bad >= 0.5]
    assert abs((sure.n_tokens * sure.p_bad * (sure.rate - 4)).sum()) < 0.02 * (sure.n_tokens * sure.p_bad).sum() and scarce.rate.max() < 4.2
    assert abs((scarce.n_tokens * scarce.p_good * (scarce.rate - 1)).sum()) < 0.001 * scarce.n_tokens.sum()
    absent = soft_mixing.mix(rows, labels, {"good": 0.7, "bad": 0.2, "none": 0.1}).toPandas()
    got = np.array([(absent.n_tokens * absent[f"p_{d}"] * absent.rate).sum() for d in ("good", "bad")])
    assert abs(got[0] / got.sum() - 7 / 9) < 0.01 and absent.copies.max() < 100


def test_pipeline_emits_each_document_copies_times(spark, monkeypatch):
    import corpus_pipeline

    copies = {"a": 0, "b": 1, "c": 3, "d": 2, "e": 0}
    docs = spark.createDataFrame([(1, "a", "en", "s", 2), (2, "b", "en", "s", 2), (3, "c", "en", "s", 2), (3, "d", "en", "s", 2), (None, "e", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars int")
    rate = F.create_map(*(F.lit(x) for kv in copies.items() for x in kv))
    monkeypatch.setattr(soft_mixing, "mix", lambda d, *_, keep, **__: d.select("doc_id", *keep, rate[F.col("text")].cast("long").alias("copies")))
    got = corpus_pipeline.mixing(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(r.text for r in got) == ["b", "c", "c", "c", "d", "d", "e"] and all(r.n_chars == 2 for r in got)


def test_pipeline_stages_equal_brute_force_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rnd = random.Random(77)
    base, passage = words(rnd, 120), words(rnd, 60)
    odd = [(1, base), (1, passage + " " + words(rnd, 60)), (2, base + " end"), (2, words(rnd, 40) + " " + passage), (3, None), (3, ""), (None, base), (None, None), (4, "$$$ ### " * 60), (5, base), (5, base), (6, words(rnd, 3000))]
    extra = spark.createDataFrame([(i, t, None, "odd", k) for k, (i, t) in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = real.unionByName(extra.select([F.col(f.name).cast(f.dataType) for f in real.schema]))
    plain = lambda df: sorted(map(str, df.select(*corpus_pipeline.COLUMNS).collect()))
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.withColumn("key", F.xxhash64("text")).collect()
        out = stage(spark, docs, sf)
        if name == "quality":
            labels = queries.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
            net = attention_mil.train(docs.where(~queries.held_out()), labels)
            score = {(r.doc_id, r.text): r.score for r in attention_mil.score(docs, net, keep=("text",)).collect()}
            assert plain(out) == plain(docs) if net is None else sorted(str(tuple(r)) for r in out.collect()) == sorted(str(tuple(r)[:5]) for r in rows if score[r.doc_id, r.text] >= 0.5)
        elif name == "near_duplicates":
            sets = [shingles(r.text) for r in rows]
            group = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and rows[a].doc_id is not None and rows[b].doc_id is not None and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
            first = {}
            for k, r in enumerate(rows):
                if r.doc_id is not None and sets[k]:
                    first[group[k]] = min(first.get(group[k], (r.doc_id, r.key, r.text)), (r.doc_id, r.key, r.text))
            want = [(r.doc_id, r.text) for k, r in enumerate(rows) if r.doc_id is None or not sets[k]] + [(i, t) for i, _, t in first.values()]
            assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, want))
        elif name == "repeated_passages":
            cleaned = repeats_brute_force([((r.doc_id, r.text), r.key) for r in rows])
            want = [(i, t) for r, (i, t) in zip(rows, cleaned, strict=True) if t == r.text or WORD.search(t)]
            assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, want)) and all(r.text is None or r.source == "odd" or r.n_chars == len(r.text) for r in out.collect())
        elif name == "mixing":
            rates = soft_mixing.mix(docs, queries.domains(queries.table(spark, sf, "labels")), queries.WEIGHTS, max_epochs=corpus_pipeline.MAX_EPOCHS, keep=("text",)).collect()
            want = [(r.doc_id, r.text) for r in rates for _ in range(r.copies if r.doc_id is not None else 1)]
            assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, want))
        else:
            digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
            assert sorted(str((r.doc_id, r.decoded_sha256)) for r in out.collect()) == sorted(str((r.doc_id, digest(r.text))) for r in rows)
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name != "tokens":
            out.write.parquet(f"file://{tmp_path}/{name}")
            docs = spark.read.parquet(f"file://{tmp_path}/{name}")


def test_pipeline_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        if name == "mixing":
            asked = queries.WEIGHTS
            rates = soft_mixing.mix(kept, queries.domains(queries.table(spark, sf, "labels")), asked, max_epochs=corpus_pipeline.MAX_EPOCHS).toPandas()
            held = {d: (rates.n_tokens * rates[f"p_{d}"]).sum() for d in asked}
            there = [d for d in asked if held[d] > 1e-6 * rates.n_tokens.sum()]
            got = {d: (rates.n_tokens * rates[f"p_{d}"] * rates.rate).sum() for d in there}
            assert all(abs(got[d] / sum(got.values()) - asked[d] / sum(asked[x] for x in there)) < 0.01 for d in there)
            assert all(got[d] < (corpus_pipeline.MAX_EPOCHS + 0.1) * held[d] for d in there)
        out.write.parquet(f"file://{tmp_path}/{name}")
        before, kept = kept, spark.read.parquet(f"file://{tmp_path}/{name}")
        assert kept.join(before, "doc_id", "left_anti").count() == 0 and 0 < kept.count() <= before.count()
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() == kept.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got, want = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(queries.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    plain = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    assert [[x.removesuffix(".0") for x in r] for r in plain(got)] == [[x.removesuffix(".0") for x in r] for r in plain(want)]

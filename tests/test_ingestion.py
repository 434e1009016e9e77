import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators import admission, fingerprints, indexing, ingest, joins, patterns, routed, segmentation, structure
from folioforge.operators.admission import Gate, Unique
from folioforge.plans import ingestion, registry, routing  # noqa: F401  register their queries
from folioforge.sources import snapshots

SF = "/root/testdata/sf0.001"


def walk(rows, keys):
    """The loop: rows in order, (seq, bad, k0, k1, ...); reasons in the order gate, keys."""
    held, out = [{} for _ in keys], {}
    for r in sorted(rows):
        reason, of = ("bad", None) if r[1] else (None, None)
        for i, name in enumerate(keys):
            if reason is None and r[2 + i] not in (None, "") and r[2 + i] in held[i]:
                reason, of = name, held[i][r[2 + i]]
        if reason is None:
            for i in range(len(keys)):
                if r[2 + i] not in (None, ""):
                    held[i][r[2 + i]] = r[0]
        out[r[0]] = (reason, of)
    return out


def settled(spark, rows, keys):
    schema = "seq long, bad boolean, " + ", ".join(f"{k} string" for k in keys)
    done = admission.admit(spark.createDataFrame(rows, schema), [Gate("bad", F.col("bad")), *(Unique(k, k) for k in keys)])
    got = {r.seq: (r.reason, r.duplicate_of) for r in done.rows.collect()}
    assert all((r[0] is None) == a for r, a in ((got[x.seq], x.accepted) for x in done.rows.collect()))
    return got, done.rounds


def test_admission_equals_a_loop_over_shuffled_rows_with_chains(spark):
    rng = random.Random(5)
    rows = [(i, rng.random() < 0.1, rng.choice([None, "", f"u{rng.randrange(3000)}"]), f"t{rng.randrange(4000)}", f"b{rng.randrange(3500)}" if rng.random() < 0.8 else "hot") for i in range(4900)]
    # a chain: each row shares one key with the next
    rows += [(10_000 + i, False, f"c{i // 2}", f"d{(i + 1) // 2}", None) for i in range(100)]
    rng.shuffle(rows)
    got, rounds = settled(spark, rows, ["u", "t", "b"])
    assert got == walk(rows, ["u", "t", "b"])
    assert 2 < rounds <= 60


def test_admission_of_random_rows_needs_few_rounds(spark):
    order = list(range(2000))
    random.Random(1).shuffle(order)
    rows = [(order[i], False, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(2000)]
    got, rounds = settled(spark, rows, ["u", "t"])
    assert got == walk(rows, ["u", "t"]) and rounds <= 12


def test_admission_without_rows_keys_or_steps(spark):
    assert settled(spark, [], ["u"]) == ({}, 0)
    assert settled(spark, [(1, False, None), (2, True, ""), (3, None, None)], ["u"])[0] == {1: (None, None), 2: ("bad", None), 3: (None, None)}
    done = admission.admit(spark.createDataFrame([(1, "x")], "seq long, accepted_by string"), [])
    assert [(r.accepted, r.reason, r.accepted_by) for r in done.rows.collect()] == [(True, None, "x")]


def test_unique_joins_with_hot_keys(spark):
    big = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(500)] + [(None, 1)], "k string, v long")
    small = big.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    assert joins.join_unique(big, small, "k", "n", least=100, most=10).count() == 3500


def known(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, quality_status string, content_hash string, text_hash string, binary_hash string, file_path string, document_kind string")


def test_articles_get_the_first_action_that_fits(spark):
    fields = "doc_id string, status string, title string, body string, category string, kind string, hint string, sensitive boolean, quality string, quality_reason string, retention string, retention_reason string, document_type string, parent_doc_id string"
    row = lambda i, **k: tuple({"doc_id": i, "status": "ok", "title": "t", "body": "b", "category": "c", "kind": "news", "hint": "", "sensitive": False, "quality": "accepted", "quality_reason": "", "retention": "active", "retention_reason": "", "document_type": "article", "parent_doc_id": ""} | k for _ in [0])[0]
    cases = [row("a"), row("b"), row("c", status="not_modified"), row("d", status="http_500"), row("e", sensitive=True), row("f", quality="low_quality"), row("g", quality="low_quality", quality_reason="footer"), row("h", retention="archived", retention_reason="old"), row("i", body=None, title=None), row("j", status=None)]
    digest = spark.range(1).select(ingest.text_hash(ingest.article_body(F.lit("t"), F.lit("b"))).alias("h"), ingest.text_hash(F.lit("b")).alias("t")).first()
    old = known(spark, [("b", "accepted", digest.h, digest.t, "", "x.md", "policy"), ("f", "accepted", "sha256:1", "", "", "f.md", "policy"), ("g", "rejected", "", "", "", "g.md", "policy"), ("e", "accepted", "sha256:1", "", "", "e.md", "policy")])
    names = [f.split()[0] for f in fields.split(", ")]
    done = ingest.ingest_articles(spark.createDataFrame([tuple(c[n] for n in names) for c in cases], fields), old)
    got = {r.doc_id: (r.action, r.reason, r.document_kind, r.writes) for r in done.collect()}
    assert got == {
        "a": ("new", "", "news", True), "b": ("unchanged", "", "policy", False), "c": ("unchanged", "not_modified", "news", False), "d": (None, None, "news", False), "e": ("quarantined", "sensitive", "incomplete", True),
        "f": ("kept_previous", "low_quality", "news", False), "g": ("rejected", "footer", "incomplete", True), "h": ("archived", "old", "news", True), "i": ("new", "", "news", True), "j": (None, None, "news", False),
    }
    assert {tuple(r) for r in ingest.dropped_files(done).collect()} == {("e", "e.md"), ("g", "g.md")}
    stored = {r.doc_id: (r.quality_status, r.content_hash != "", r.file_path != "") for r in ingest.manifest_rows(done).collect()}
    assert stored["a"] == ("accepted", True, True) and stored["g"] == ("low_quality", False, False) and stored["h"] == ("accepted", False, False) and "f" not in stored


def plain_attachments(rows, parents, old):
    files, urls, out, relations = {}, set(), {}, set()
    for seq, parent, doc, file, parse, text, bad in sorted(rows):
        if parents.get(parent) in (None, "quarantined"):
            continue
        if file is not None and files.setdefault(file, doc) != doc:
            out[seq] = "relation_only"
            relations.add((parent, files[file]))
            continue
        if doc in urls:
            out[seq] = "relation_only"
        else:
            urls.add(doc)
            o = old.get(doc)
            if parse != "ok" or not text:
                out[seq] = "kept_previous" if o == "accepted" else "rejected"
            elif bad:
                out[seq] = "quarantined"
                continue
            else:
                out[seq] = "updated" if o else "new"
        relations.add((parent, doc))
    return out, relations


def test_attachments_equal_a_walk_in_order(spark):
    rng = random.Random(3)
    rows = []
    for seq in range(600):
        doc = f"d{rng.randrange(120)}"
        rows.append((seq, f"p{rng.randrange(30)}", doc, rng.choice([None, "hot", f"f{rng.randrange(150)}"]), rng.choice(["ok", "ok", "parse_failed", None]), rng.choice(["x", "", None, "text"]), rng.random() < 0.1))
    parents = {f"p{i}": ("quarantined" if i % 7 == 0 else "rejected" if i % 5 == 0 else "new") for i in range(29)}
    old = {f"d{i}": ("accepted" if i % 2 else "rejected") for i in range(0, 120, 3)}
    a = spark.createDataFrame(rows, "seq long, parent_doc_id string, doc_id string, binary_hash string, parse_status string, text string, sensitive boolean")
    a = a.withColumn("name", F.col("doc_id")).withColumn("stored_text", F.col("text")).withColumn("category", F.lit("c")).withColumn("kind", F.lit("manual")).withColumn("retention", F.lit("active")).withColumn("retention_reason", F.lit(""))
    p = spark.createDataFrame([(k, v, "") for k, v in parents.items()], "doc_id string, action string, reason string")
    got, relations = ingest.ingest_attachments(a, p, known(spark, [(k, v, "sha256:0", "sha256:0", "z", "x.md", "manual") for k, v in old.items()]))
    want = plain_attachments(rows, parents, old)
    assert {r.seq: r.action for r in got.collect()} == want[0]
    assert {tuple(r) for r in relations.collect()} == want[1]


def items_of(spark, rows):
    return indexing.indexable(spark.createDataFrame(rows, "doc_id string, title string, text string, document_kind string, publisher string, retention_status string"))


def index_rows(store):
    return sorted(map(str, store.rows(store.snapshot()).orderBy("collection", "chunk_id").collect()))


def test_an_updated_index_equals_one_built_anew(spark, tmp_path):
    before = [(f"d{i}", f"title {i}", f"text {i} " * (i + 1), ("policy", "public_list", "news")[i % 3], "p", "active") for i in range(30)] + [("e", "t", " ", "policy", "p", "active")]
    after = [(d, t, x + ("!" if i % 4 == 1 else ""), k if i % 5 else "policy", p + ("2" if i % 4 == 2 else ""), "historical" if i % 11 == 0 else r) for i, (d, t, x, k, p, r) in enumerate(before) if i % 4 != 3] + [("n", "new", "new text", "faq", "p", "active")]
    make = lambda name: snapshots.SnapshotTable(spark, f"file://{tmp_path}/{name}", indexing.CHUNKS, "doc_id", 8)
    a, b, embedder = make("a"), make("b"), indexing.Embedder()
    first = indexing.build(a, items_of(spark, before), embedder)
    assert (first.added, first.skipped, first.version) == (21, 1, 1)
    old = a.snapshot()
    report = indexing.update(a, items_of(spark, after), embedder)
    indexing.build(b, items_of(spark, after), embedder)
    assert index_rows(a) == index_rows(b) and report.version == 2 and report.deleted and report.updated and report.metadata_only and report.added
    # nothing changed: the version stays; earlier versions stay readable until released
    assert indexing.update(a, items_of(spark, after), embedder).version == 2
    assert a.rows(old).count() == first.chunks
    assert a.release(keep=1) > 0 and a.versions() == [2] and index_rows(a) == index_rows(b)
    # a change in one document rewrites one bucket
    changed = [(d, t + "x" if d == "n" else t, *rest) for d, t, *rest in after]
    assert indexing.update(a, items_of(spark, changed), embedder).buckets == 1
    # one deleted to the last document
    assert indexing.update(a, items_of(spark, after[:0]), embedder).chunks == 0


def test_a_refused_or_late_writer_changes_nothing(spark, tmp_path):
    store = snapshots.SnapshotTable(spark, f"file://{tmp_path}/s", T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())]), "k", 4)
    rows = lambda *v: spark.createDataFrame([(f"k{i}", i) for i in v], store.schema)
    base = store.commit(rows(*range(20)), None, {"a": 1})
    with pytest.raises(snapshots.Refused):
        store.commit(rows(1), base, {}, None, lambda staged: "no" if staged.count() else None)
    assert store.versions() == [1] and store.rows(store.snapshot()).count() == 20
    won = store.commit(rows(1, 2), base, {})
    with pytest.raises(snapshots.Conflict):
        store.commit(rows(3), base, {})
    with pytest.raises(snapshots.Refused):
        store.commit(rows(*range(20)), won, {}, touched={0})
    assert store.versions() == [1, 2] and store.rows(store.snapshot()).count() == 2 and store.snapshot(7) is None
    store.release()
    assert len(store._names("data")) >= 1 and store.rows(store.snapshot()).count() == 2


def test_an_index_of_another_model_is_refused(spark, tmp_path):
    store = snapshots.SnapshotTable(spark, f"file://{tmp_path}/m", indexing.CHUNKS, "doc_id", 4)
    rows = items_of(spark, [("a", "t", "x", "policy", "p", "active")])
    indexing.build(store, rows, indexing.Embedder())
    with pytest.raises(snapshots.Refused, match="embedding_model"):
        indexing.update(store, rows, indexing.Embedder(model="other"))
    with pytest.raises(snapshots.Refused, match="bad"):
        indexing.build(store, rows, indexing.Embedder(), validate=lambda staged: "bad")
    assert store.versions() == [1]


def test_an_audit_must_cover_the_documents(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, x string")
    verdicts = lambda *v: spark.createDataFrame(list(v), "doc_id long, keep boolean")
    assert [r.doc_id for r in indexing.rebuilt_corpus(rows, verdicts((1, True), (2, False))).collect()] == [1]
    for bad in ([(1, True)], [(1, True), (2, True), (3, True)], [(1, True), (2, True), (2, True)]):
        with pytest.raises(snapshots.Refused):
            indexing.rebuilt_corpus(rows, verdicts(*bad))


def test_shut_blocks_change_no_hit_and_save_most_postings(spark):
    rng = np.random.default_rng(2)
    rare = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(1500):
        words = ["the"] * int(rng.geometric(0.5)) + ["of"] * int(rng.geometric(0.5) - 1) + list(rng.choice(rare, int(rng.integers(5, 40))))
        rows.append(("ab"[i % 7 == 0], f"c{i:04d}", " ".join(words)))
    rows += [(None, "x", "the"), ("a", "nul", None), ("a", "empty", "")]
    chunks = spark.createDataFrame(rows, "collection string, chunk_id string, text string")
    questions = spark.createDataFrame([(1, "a", "the of"), (2, "b", "the of w3"), (3, "a", "w1 w2 the the"), (4, "a", "nowhere"), (5, "a", None)], "question_id long, collection string, text string")
    postings = routed.impacts(chunks)
    hits, work = routed.lexical(postings, routed.blocks(postings), questions, k=10)
    asked = questions.select("question_id", "collection", F.explode(routed.words_of(F.col("text"))).alias("term")).groupBy("question_id", "collection", "term").count()
    whole = postings.join(asked, ["collection", "term"]).groupBy("question_id", "collection", "chunk_id").agg(F.round(F.sum(F.col("count") * F.col("impact")), 6).alias("score")).where("score > 0").collect()
    want = {}
    for q in (1, 2, 3):
        mine = sorted(((-r.score, r.chunk_id) for r in whole if r.question_id == q))[:10]
        want[q] = [(c, -s) for s, c in mine]
    got = {}
    for r in hits.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    assert got == want
    opened = {r.question_id: (r.opened, r.postings) for r in work.collect()}
    assert all(opened[q][0] * 2.5 <= opened[q][1] for q in (1, 3))  # the larger the collection, the more it saves


def test_merged_routes_keep_the_order_of_collections(spark):
    hits = spark.createDataFrame([(1, "main", f"m{i}", f"d{i % 2}", i) for i in range(1, 6)] + [(1, "list", f"l{i}", "d9", i) for i in range(1, 6)] + [(1, "list", "m1", "d1", 6), (1, "other", "o", "d", 1)], "question_id long, collection string, chunk_id string, doc_id string, rank int")
    got = routed.merge_routes(hits, spark.createDataFrame([(1, ["main", "list"])], "question_id long, route array<string>")).orderBy("place").collect()
    assert [r.chunk_id for r in got] == ["m1", "m2", "m3", "m4", "m5", "l1", "l2", "l3"]
    assert [r.card for r in got] == [1, 2, 1, 2, 1, 3, 3, 3]


def best_cut(run, logs, longest, unknown):
    best, step = [0.0], [0]
    for i in range(1, len(run) + 1):
        options = [(best[i - k] + (logs.get(run[i - k : i], unknown if k == 1 else -np.inf)), k) for k in range(min(i, longest), 0, -1)]
        value, k = max(options, key=lambda o: o[0])
        best.append(value)
        step.append(k)
    out, at = [], len(run)
    while at:
        out.append(run[at - step[at] : at])
        at -= step[at]
    return out[::-1]


def test_cuts_equal_a_plain_dynamic_programme(spark):
    rng = random.Random(8)
    vocabulary = ["招生", "简章", "奖学金", "学生", "办法", "的", "大学", "评选"]
    texts = ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) + rng.choice(["", " Abc_1 ", "，"]) + rng.choice(vocabulary) for _ in range(400)] + ["", "x y", "招" * 3000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = segmentation.dictionary(docs, least=5).collect()
    found = {r.word for r in table}
    assert {"招生", "奖学金", "评选"} <= found
    words = segmentation.load(segmentation.dictionary(docs, least=5))
    logs = {r.word: float(np.log(r.n / sum(x.n for x in table))) for r in table}
    import re

    for r in segmentation.segment(docs, words).collect():
        want = []
        for piece in re.findall(r"[㐀-䶿一-鿿]+|[a-z0-9_]+", (texts[r.doc_id] or "").lower()):
            want += best_cut(piece, logs, words.longest, words.unknown) if piece[0] > "ʰ" else [piece]
        assert r.terms == want, r.doc_id
    nothing = segmentation.load(segmentation.dictionary(docs.limit(0)))
    assert segmentation.segment(docs.limit(3), nothing).where("size(terms) > 0").count() == 3


def test_segments_of_the_query_equal_a_plain_cut(spark):
    docs = routing._unspaced(spark, SF)
    table = segmentation.dictionary(docs, ranges=segmentation.LATIN).collect()
    total = sum(r.n for r in table)
    logs = {r.word: float(np.log(r.n / total)) for r in table}
    unknown = float(np.log(segmentation.UNKNOWN * min(r.n for r in table) / total))
    got = {r.doc_id: r.terms for r in routing._segmented(spark, SF).collect()}
    import re

    for d in docs.limit(10).collect():
        want = []
        for piece in re.findall(r"[a-zß-öø-ɏ]+|[0-9_]+", d.text.lower()):
            want += best_cut(piece, logs, max(len(r.word) for r in table), unknown) if piece[0].isalpha() else [piece]
        assert got[d.doc_id] == want


def test_hash_trees_tell_equal_tables_and_what_differs(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(None, None), (7, "text 7")]
    make = lambda r, parts: spark.createDataFrame(r, "k long, v string").repartition(parts)
    build = lambda t: fingerprints.tree(t, F.col("k"), F.concat_ws("|", F.col("k").cast("string"), "v"))
    a, b = build(make(rows, 2)), build(make(rows[::-1], 7))
    assert fingerprints.root(a) == fingerprints.root(b) != "" and fingerprints.difference(a, b) == fingerprints.Difference([], 1)
    assert fingerprints.root(build(make(rows[:-1], 2))) != fingerprints.root(a)  # a repeated row counts
    other = [(k, "new" if k == 17 else v) for k, v in rows if k != 99] + [(9999, "more")]
    d = fingerprints.difference(a, build(make(other, 3)))
    assert len(d.leaves) == 3 and d.compared <= 1 + 16 + 3 * 16 + 3 * 16
    plain = lambda r: make([x for x in r if x[0] is not None and x != (7, "text 7")] + [(7, "text 7")], 3).distinct()
    assert {tuple(r) for r in fingerprints.changed_rows(plain(rows), plain(other), "k", d.leaves).collect()} == {(17, "changed"), (99, "deleted"), (9999, "added")}
    empty = build(make([], 1))
    assert fingerprints.root(empty) == "" and len(fingerprints.difference(empty, a).leaves) == a.where("level = 3").count()


def test_patterns_equal_counts_of_overlapping_matches(spark, monkeypatch):
    rng = random.Random(4)
    letters = "abé招"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 80))) for _ in range(200)] + [None, "", "aaaaaa"]
    names = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(300)}) + ["aa", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([(n,) for n in [*names, names[0], "", None]], "pattern string")
    count = lambda t, p: sum(t.startswith(p, i) for i in range(len(t)))
    want = {(i, p): count(t or "", p) for i, t in enumerate(texts) for p in names if p in (t or "")}
    for most in (1 << 20, 100):
        got = {(r.doc_id, r.pattern): r.n for r in patterns.matches(docs, wanted, most=most).collect()}
        assert got == want
    assert patterns.matches(docs, wanted.limit(0)).count() == 0 and patterns.matches(docs.limit(0), wanted).count() == 0


def test_page_structure_with_broken_nesting(spark):
    html = '<!DOCTYPE html><div class="list box"><ul><li><a href="/a">A</a><br><li><a class="own" href=\'/b\'>B</a></ul></div><p><a href="#x">C</a></p></p></div><a href="/d">D</a><!-- <a href="/no"> --><script>"<a>"</script><iframe src="/f.pdf"></iframe><embed src="/e.pdf"/>'
    crumb = '<div><span class="breadcrumb">首页 &gt; <b>通知</b> > 招生</span> more</div>'
    pages = spark.createDataFrame([(1, html), (2, crumb), (3, None), (4, ""), (5, "no tags"), (6, '<i class="crumb">open > end')], "page_id long, html string")
    rows = structure.tokens(pages)
    got = {r.pos: r.signature for r in structure.signature(rows).where("page_id = 1").collect()}
    assert list(dict(sorted(got.items())).values()) == ["div.list.box", "a.own", "div.list.box", "a"]
    links = {(r.tag, r.url, r.embedded) for r in structure.resource_links(rows).where("page_id = 1").collect()}
    assert links == {("a", "/a", False), ("a", "/b", False), ("a", "/d", False), ("iframe", "/f.pdf", True), ("embed", "/e.pdf", True)}
    assert {r.page_id: r.parts for r in structure.breadcrumbs(rows, drop=("首页 &gt;",)).collect()} == {2: ["首页 &gt; 通知", "招生"], 6: ["open", "end"]}


def test_contacts_count_what_was_put_in(spark, tmp_path):
    import duckdb

    texts = ['key. token = "068c002651439458202064d35406d6b34bf01abe", end. x', "Call 13912345678, or. 4041894974608795 is it. 110105194912310020 no", None, ""]
    d = spark.createDataFrame([(i, t, f"src{i % 7}", n) for i, (t, n) in enumerate((t, n) for t in texts for n in (14, 15))], "doc_id long, text string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()["p11_contacts"]).fetchall()
    assert sorted(map(tuple, ingestion.p11_contacts(spark, str(tmp_path)).collect())) == sorted(tuple(map(int, r)) for r in want)


def test_segmentation_works_on_bounded_slices_of_a_batch(monkeypatch):
    import pyarrow as pa

    seen, whole = [], segmentation._codes
    monkeypatch.setattr(segmentation, "_codes", lambda texts: seen.append(len(texts)) or whole(texts))
    texts = ["abcabd" * k for k in range(60)] + [None, "", "x" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    def counts():
        out = {}
        for b in segmentation._counted(4, segmentation.LATIN)(iter([batch])):
            for g, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[g] = out.get(g, 0) + n
        return out

    want, parts = counts(), len(seen)
    monkeypatch.setattr(segmentation, "SLICE", 400)
    assert counts() == want and want["^abc"] == 59
    assert parts == 1 and len(seen) - parts > 20 and sum(seen[parts:]) == len(texts)


def test_patterns_are_searched_in_bounded_slices_of_a_batch(monkeypatch):
    import pyarrow as pa

    texts = ["abab", None, "", "b" * 30, "ab"] * 40
    table, sizes = patterns.Patterns([b"ab", b"ba", b"bab"]), []
    find = table.find
    monkeypatch.setattr(patterns.Patterns, "find", lambda self, data: sizes.append(len(data)) or find(data))
    monkeypatch.setattr(patterns, "BYTES", 64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = {(i, p): n for b in patterns._searched(table, "doc_id")(iter([batch])) for i, p, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == {(i, p): n for i, t in enumerate(texts) for p, n in ((0, (t or "").count("ab")), (1, (t or "").count("ba")), (2, (t or "").count("bab"))) if n}
    assert max(sizes) <= 64 and sum(sizes) == sum(len(t or "") for t in texts)


def test_sums_of_many_questions_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(3)
    held = {(f"c{i % 2}", f"k{i:03d}", f"t{t}"): rng.choice([0.5, 1.0, -0.25, rng.random()]) for i in range(90) for t in rng.sample(range(12), 5)}
    asks = {(q, f"c{c}", f"t{t}"): rng.randrange(1, 3) for q in range(9) for c in (0, 1) for t in rng.sample(range(14), 3)}
    postings = spark.createDataFrame([(*k, v) for k, v in held.items()], "collection string, chunk_id string, term string, impact double").repartition(3)
    asked = spark.createDataFrame([(*k, v) for k, v in asks.items()], "question_id long, collection string, term string, qf long")
    sums = {}
    for (c, k, t), x in held.items():
        for q in range(9):
            if (q, c, t) in asks:
                sums[q, c, k] = sums.get((q, c, k), 0.0) + x * asks[q, c, t]
    want = {}
    for q, c in {x[:2] for x in sums}:
        want |= {(q, c, k): round(-s, 6) for s, k in sorted((-round(s, 6), k) for (a, b, k), s in sums.items() if (a, b) == (q, c) and round(s, 6) > 0)[:4]}
    fourth = {}
    for (q, c, _), s in want.items():
        fourth[q, c] = min(s, fourth.get((q, c), s))
    bar = spark.createDataFrame([(q, c, s * (1 - 1e-9)) for (q, c), s in fourth.items() if q % 2], "question_id long, collection string, bar double")
    monkeypatch.setattr(routed, "CELLS", 40)
    order = routed.F.row_number().over(routed.Window.partitionBy("question_id", "collection").orderBy(F.desc("score"), "chunk_id"))
    for most in (100, 3):
        rows = routed._whole(postings, asked, bar, 4, most).where("score > 0").withColumn("r", order).where("r <= 4").collect()
        got = {(r.question_id, r.collection, r.chunk_id): r.score for r in rows}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1.5e-6 for x in want)


def test_lists_of_asked_terms_give_the_hits_and_blocks_of_all_postings(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the"] * 30 + ["of"] * 20 + [f"w{i}" for i in range(150)]
    rows = [("ab"[i % 4 == 0], f"c{i:04d}", " ".join(rng.choices(words, k=rng.randrange(1, 50)))) for i in range(900)]
    rows += [(None, "x", "the"), ("a", "nul", None), ("a", "empty", ""), ("b", "none", "zzz"), ("z", "own", "of")]
    chunks = spark.createDataFrame(rows, "collection string, chunk_id string, text string").repartition(3)
    texts = ["the of", "w3 of the the", "w1 w2 w3 w4", "nowhere", None, "zzz the nowhere"]
    questions = spark.createDataFrame([(i, c, t) for i, t in enumerate(texts) for c in ("a", "b", "none")], "question_id long, collection string, text string")
    postings = routed.impacts(chunks)
    hits, work = (set(map(tuple, df.collect())) for df in routed.lexical(postings, routed.blocks(postings), questions, k=5))
    assert len(hits) > 30 and len(work) > 6
    monkeypatch.setattr(routed, "WORDS", 700)
    monkeypatch.setattr(routed, "CELLS", 640)
    monkeypatch.setattr(routed, "impacts", None)  # nothing shuffles postings by chunk
    assert set(map(tuple, routed.blocks_opened(chunks, questions, k=5).collect())) == work
    assert set(map(tuple, routed.lexical_hits(chunks, questions, k=5).select("question_id", "collection", "chunk_id", "score", "rank").collect())) == hits
    lists, block, asked = routed._held(chunks, questions, routed.words_of)
    first = block.where("level > 8").join(asked.drop("number"), routed.TERM)
    best = lambda most: sorted((r.question_id, r.collection, round(r.score, 9)) for r in routed._score_lists(first, asked, lists, 10_000, most).collect())
    assert len(best(100)) > 100 and best(100) == best(2)
    want = routed._score(first, asked.drop("number"), postings).where("score > 0").collect()
    assert best(100) == sorted((r.question_id, r.collection, round(r.score, 9)) for r in want)
    monkeypatch.undo()
    rest = routed._held(chunks, questions, routed.words_of, most=3)
    assert set(map(tuple, routed._bars(*rest, 5)[1].collect())) == work  # more asked terms than go along with tasks


def test_every_opening_turn_asks_the_routed_queries(spark, tmp_path):
    import duckdb

    rng, words = random.Random(8), [f"w{i}" for i in range(60)] + ["the", "and"] * 10
    docs = [(i, ("# " if i % 5 == 0 else "") + " ".join(rng.choices(words, k=rng.randrange(5, 200))), ("de", "en")[i % 3 > 0], "s", 1) for i in range(60)]
    turns = [(i, 0, "user", " ".join([f"w{i}", *rng.choices(words, k=4)])) for i in range(24)] + [(3, 1, "user", "w1 w2 w3"), (50, 0, "user", None)]
    tables = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "conversations": (turns, "conv_id long, turn long, role string, text string"), "benchmark": ([(1, "w1 w2 and the")], "item_id long, text string")}
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    ids = {1, *range(-24, 0)}
    for name in ("r09_lexical_by_collection", "r09_routed_search"):
        got = set(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))
        assert got == set(con.sql(registry.oracle_sql()[name]).fetchall()) and {r[0] for r in got} == ids
    assert {r.question_id for r in registry.queries()["r09_blocks_opened"](spark, str(tmp_path)).collect()} == ids


def test_sums_of_common_terms_are_bounded_in_memory(spark):
    import tracemalloc

    postings = spark.createDataFrame([("all", f"{i:04d}", f"t{t}", 1.0 + i % 7 + t / 64) for i in range(500) for t in range(20)], "collection string, chunk_id string, term string, impact double").coalesce(1)
    asked = spark.createDataFrame([(q, "all", f"t{(q + t) % 20}", 1 + (t == 0)) for q in range(1500) for t in range(10)], "question_id long, collection string, term string, qf long")
    bar = spark.createDataFrame([], "question_id long, collection string, bar double")
    plain = type(postings).mapInArrow

    def watched(self, f, schema):
        def run(batches):
            tracemalloc.start()
            yield from f(batches)
            if tracemalloc.get_traced_memory()[1] > 64e6:
                raise MemoryError(tracemalloc.get_traced_memory()[1])

        return plain(self, run, schema)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(postings), "mapInArrow", watched)
        rows = routed._whole(postings, asked, bar, 4).collect()
    best = {}
    for r in rows:
        best.setdefault(r.question_id, []).append((-r.score, r.chunk_id))
    for q in (0, 7, 1499):
        want = sorted((-round(sum((1 + (t == 0)) * (1.0 + i % 7 + (q + t) % 20 / 64) for t in range(10)), 6), f"{i:04d}") for i in range(500))[:4]
        assert sorted(best[q])[:4] == want


def test_equal_question_vectors_are_searched_once(spark, monkeypatch):
    rng = random.Random(11)
    chunks = spark.createDataFrame([("ab"[i % 3 == 0], f"c{i:03d}", [float(rng.randrange(4)) for _ in range(4)]) for i in range(80)], "collection string, chunk_id string, vector array<double>")
    kinds = [[1.0, 0.0, 1.0, 1.0], [0.0, 2.0, 0.0, 1.0], [0.0] * 4, None]
    questions = spark.createDataFrame([(q, c, kinds[q % 4]) for q in range(40) for c in "ab"], "question_id long, collection string, vector array<double>")
    want, asked, plain = set(map(tuple, routed.nearest(chunks, questions, 5, "collection", "chunk_id").select("question_id", "collection", "chunk_id", "score", "rank").collect())), [], routed.nearest
    monkeypatch.setattr(routed, "nearest", lambda c, q, *rest: asked.append(q.count()) or plain(c, q, *rest))
    assert set(map(tuple, routed.dense(chunks, questions, 5).collect())) == want and len(want) == 200
    assert asked == [8]


def test_blocks_stay_shut_as_in_a_plain_loop():
    import pyarrow as pa

    rng, rows, want = random.Random(4), [], {}
    for q in range(60):
        bar, of_q = (None if q % 9 == 0 else rng.uniform(1, 9)), []
        for t in range(rng.randrange(1, 5)):
            of_q += [(q, "a", f"t{t}", level, rng.choice([0.0, level / 8 + rng.random()]), rng.randrange(1, 400), bar) for level in sorted(rng.sample(range(33), rng.randrange(1, 20)))]
        whole, best = sum(r[5] for r in of_q), (0, 0)
        for j in range(-24, 25) if bar else ():
            paid = saved = 0
            for t in {r[2] for r in of_q}:
                picks = [(-1.0, 0, 0.0, 0)]
                for r in (mine := [r for r in of_q if r[2] == t]):
                    below = [x for x in mine if x[3] <= r[3]]
                    cost, n = max(x[4] for x in below), sum(x[5] for x in below)
                    picks.append((n - 2.0 ** (j / 4.0) * whole / bar * cost, r[3], cost, n))
                if max(picks)[0] > 0:
                    paid, saved = paid + max(picks)[2], saved + max(picks)[3]
            if paid < bar:
                best = max(best, (saved, j))
        want[q, "a"] = (whole - best[0], whole)
        rows += of_q
    names = ["question_id", "collection", "term", "level", "bound", "n", "bar"]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    for size in (7, 100, len(rows)):
        got = {}
        for b in routed._choices(whole.slice(lo, size) for lo in range(0, len(rows), size)):
            got |= {(r["question_id"], r["collection"]): (r["opened"], r["postings"]) for r in b.to_pylist()}
        assert got == want
    assert sum(o < n for o, n in want.values()) > 30

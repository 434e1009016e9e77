import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.functions import cascades, rules, text, web
from folioforge.operators import catalog, chunking, evaluation, links, reports, retrieval, versions
from folioforge.plans import crawling, files, governance, ingestion, pages, registry, routing, structures  # noqa: F401
from folioforge.sources import attachments, tables
from folioforge.streaming import state

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    return f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark", "labels", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = [sorted(map(str, ([plain(v) for v in r] for r in x[sorted(x.columns)].itertuples(index=False)))) for x in (want, got)]
    assert rows[0] == rows[1]


def test_rate_limit_equals_a_fold(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts").toPandas().sort_values(["ts", "event_id"])
    held, want = {}, {}
    for e in events.itertuples():
        t = held.setdefault(e.user_id, [])
        t[:] = [x for x in t if (e.ts - x).total_seconds() <= 3600]
        want[e.event_id] = len(t) < 2
        if want[e.event_id]:
            t.append(e.ts)
    assert {r.event_id: r.allowed for r in registry.queries()["z03_rate_limit"](spark, SF).collect()} == want


def test_text_functions(spark):
    assert one(spark, text.squash(F.col("t")), t=" a　b\x1c\nc ") == "abc"
    assert one(spark, text.url_key(F.col("t")), t="HTTP://Ex.ORG/A/b/?q=1#f") == "http://ex.org/A/b?q=1"
    assert one(spark, text.recency_weight(F.col("t"), 2026), t="2024-01-01") == pytest.approx(0.85**2)
    assert [one(spark, text.recency_weight(F.col("t"), 2026), t=x) for x in ("unknown", "1990", "2030")] == [0.7, 0.4, 1.0]
    assert one(spark, text.citations_ok(F.col("t"), F.lit(2)), t="a [1] b [ 2 ] [2021]") and not one(spark, text.citations_ok(F.col("t"), F.lit(2)), t="a [99]")
    v = one(spark, text.trigram_vector(F.col("t")), t="abcd")
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1)


def test_chunks_of_articles_and_sections(spark):
    docs = spark.createDataFrame([(1, "总则\n第一条 甲\n第二条 乙"), (2, "一、甲\n二、乙"), (3, "x" * 1000), (4, ""), (5, None)], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_index, r.heading, len(r.text)) for r in chunking.split_documents(docs).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, "", 2), (1, 1, "第一条", 5), (1, 2, "第二条", 5), (2, 0, "一、", 3), (2, 1, "二、", 3), (3, 0, "", 480), (3, 1, "", 480), (3, 2, "", 140)]
    with pytest.raises(ValueError):
        chunking.pieces(F.col("text"), 10, 10)


def test_quality_pack(spark):
    def status(title, body, has=False, date="unknown"):
        r = rules.quality_reasons(F.col("t"), F.col("b"), F.col("h"), F.col("d"), F.lit("policy"), rules.ZH_QUALITY)
        return one(spark, rules.quality_status(r), t=title, b=body, h=has, d=date)

    assert status("关于某事", "详见附件") == "incomplete_document"
    assert status("首页", "内容" * 100) == "low_quality" and status("03a91ba5c9a8", "内容" * 100) == "low_quality"
    assert status("某办法", "内容。" * 60) == "accepted" and status("某某学院关于某项名单的公示公告", "短", date="2025-01-01") == "accepted"


def test_versions_pair_neighbours(spark):
    rows = [("g", 1, "2021-01-01"), ("g", 2, "2022-01-01"), ("g", 3, "2023-01-01"), ("g", 4, "unknown"), ("h", 5, "2020-01-01"), ("h", 6, "2020-01-01")]
    got = versions.superseding(spark.createDataFrame(rows, "group_key string, doc_id long, publish_date string")).collect()
    assert [tuple(r) for r in got] == [("g", 3, 2)]
    assert one(spark, versions.policy_name(F.col("t")), t="关于印发《某办法（修订）》的通知") == "某办法"


def test_series_key(spark):
    assert one(spark, catalog.series_key(F.col("t"), F.lit("处"), F.lit("")), t="关于2025年度奖学金评选的通知") == "处|all|奖学金评选"


def test_ranking_helpers(spark):
    hits = spark.createDataFrame([(1, 10, r) for r in range(1, 6)] + [(1, 11, 6)], "question_id long, doc_id long, rank int")
    capped = retrieval.cap_per_document(hits).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in capped] == [(10, 1), (10, 2), (10, 3), (11, 4)]
    assert [r.card for r in retrieval.source_cards(hits).orderBy("rank").collect()] == [1] * 5 + [2]
    assert one(spark, retrieval.routes(F.col("q")), q="旧版名单") == ["main_qa", "public_list", "historical"]


def test_longest_alias_and_attachments(spark):
    aliases = spark.createDataFrame([("A", "stu", 0), ("B", "student", 1), ("C", "offices", 2)], "unit string, alias string, position int")
    assert evaluation.longest_alias(spark.createDataFrame([("student office",)], "title string"), aliases).first()["unit"] == "B"
    found = spark.createDataFrame([(1, 0, "/a.pdf", ""), (1, 1, "/a.pdf", "form"), (1, 2, "/x", "download"), (1, 3, "/files/b.doc", "附件")], "page_id long, pos int, href string, anchor string")
    got = [(r.href, r.score, r.anchor) for r in links.attachment_candidates(found).orderBy("rank").collect()]
    assert got == [("/files/b.doc", 1.1, "附件"), ("/a.pdf", 0.5, "form")]


def test_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('# note\n{"a": 1}\n\n{bad\n{"a": 2}\n')
    got = tables.read_lines(spark, f"file://{tmp_path}/q.jsonl", tables.T.StructType([tables.T.StructField("a", tables.T.LongType())]), comments=True)
    assert sorted(r.a for r in got.collect()) == [1, 2]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_bytes(b"%PDF-1.4")
    (tmp_path / "d" / ".hidden").write_bytes(b"x")
    (tmp_path / "d" / "y.docx").write_bytes(b"PK\x03\x04")
    assert sorted((r.name, r.kind) for r in tables.read_files(spark, f"file://{tmp_path}/d").collect()) == [("x.txt", "pdf"), ("y.docx", "docx")]
    assert one(spark, tables.decode_html(F.col("b")), b="中文".encode("gb18030")) == "中文" == one(spark, tables.decode_html(F.col("b")), b="中文".encode())
    r = spark.createDataFrame([("a", "b", "x", "e", 1.0, "t")] * 2, tables.RELATION)
    tables.save_relations(r, f"file://{tmp_path}/r")
    assert tables.read_relations(spark, f"file://{tmp_path}/r").count() == 1


def test_stream_of_counts(spark):
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events*.parquet")
    q = state.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 1000


def test_document_kinds_in_rule_order(spark):
    rows = [
        ("2024 年国家奖学金评审通知", "", "accepted", False, "annual_notice"),
        ("学生管理办法", "第一条 为了", "accepted", False, "policy"),
        ("2024 年拟录取名单公示", "", "accepted", False, "public_list"),
        ("关于印发《学生活动管理办法》的通知", "", "accepted", False, "policy"),
        ("新闻与传播硕士 2027 年推免通知", "", "accepted", False, "annual_notice"),
        ("学校新闻", "", "accepted", False, "news"),
        ("开放日", "", "accepted", False, "promotion"),
        ("甲", "下载申请表", "accepted", False, "form"),
        ("甲", "下载申请表" + "字" * 300, "accepted", False, "incomplete"),
        ("甲", "乙", "accepted", True, "manual"),
        ("学生管理办法", "", "rejected", True, "incomplete"),
        (None, None, None, None, "incomplete"),
    ]
    got = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, t string, b string, s string, a boolean")
    got = got.select("i", cascades.document_kind(*map(F.col, "tbsa")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [r[4] for r in rows]


def test_admission_levels_topics_and_facts(spark):
    rows = [
        ("奖学金办法", "招生", "", "其他"),
        ("课程培训班招生简章", "", "non_degree_program", "非学历项目"),
        ("课程培训班招生简章", "授予硕士学位", "other_admission", "其他招生"),
        ("接收推免生", "", "recommendation_admission", "推免/预推免"),
        ("夏令营报名", "选拔", "recommendation_admission", "推免/预推免"),
        ("硕士复试", "", "reexamination", "复试/调剂"),
        ("博士招生", "", "doctoral_admission", "博士招生"),
        ("博士招生", "MBA", "master_admission", "硕士招生"),
        ("报名", "高考", "undergraduate_admission", "本科招生"),
        ("转专业", "", "", "转专业"),
        ("甲", "暑校", "", "国际项目"),
        (None, None, "", "其他"),
    ]
    level = cascades.admission_level(F.col("t"), F.col("b"))
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, b string")
    got = got.select("i", level.alias("level"), cascades.topic(F.col("t"), F.col("b"), level).alias("topic")).orderBy("i").collect()
    assert [(r.level, r.topic) for r in got] == [r[2:] for r in rows]
    assert one(spark, cascades.fact_signals(F.col("t")), t="3 月 5 日 报名") == ["action", "date"]
    assert not one(spark, cascades.has_facts(F.col("t")), t="加油")
    assert one(spark, cascades.date_gate(F.col("d"), F.lit(False)), d="2023-12-31").asDict() == {"open": False, "reason": "too_old"}
    urls = {"https://W.example/s/a": True, "http://w.example/s?b=1": True, "ftp://w.example/s": False, "https://w.example/x/s": False, "": False}
    assert {u: one(spark, cascades.article_url(F.col("u"), "w.example"), u=u) for u in urls} == urls
    said = {"资料未提及。好": True, "好。资料未提及": False, "好\n \n资料未提及": False, "资料齐全": False}
    assert {a: one(spark, cascades.evidence_refusal(F.col("a")), a=a) for a in said} == said
    assert one(spark, cascades.trim_lines(F.col("a")), a="a \t\nb  ") == "a\nb"


def test_grounding_and_points(spark):
    schema = "s string, h array<struct<doc_id: string, similarity: double, document_kind: string, publish_date: string>>, m array<string>"
    rows = [
        ("answerable", [("a", None, "faq", None), ("b", 0.8, "procedure", "2020"), ("b", 0.7, "procedure", "2020"), ("c", 0.6, "annual_notice", "2024-01-01"), ("d", 0.6, "faq", None)], []),
        ("answerable", [("a", 0.52, "faq", "")], []),
        ("answerable", [("a", 0.9, "news", "2026-01-01"), ("b", 0.8, "annual_notice", "2019-01-01")], []),
        ("not_answerable", None, ["why"]),
        ("answerable", None, None),
    ]
    got = [r.g for r in spark.createDataFrame(rows, schema).select(cascades.grounding(F.col("s"), F.col("h"), F.col("m"), 2026).alias("g")).collect()]
    assert [(g.status, g.doc_ids) for g in got] == [("grounded", ["b", "c"])] + [("needs_docs", [])] * 4
    assert [g.reason for g in got[1:4]] == ["top 相似度 0.52 低于固化线 0.55", "命中文档类型不足以作为依据（annual_notice、news）", "why"]
    point = cascades.point_supported(F.col("b"), F.col("p"))
    assert one(spark, point, b="请带身份证明", p="申请材料") and one(spark, point, b="甲 (乙)", p="(乙)")
    assert not one(spark, point, b="甲", p="办理材料")


def test_collection_stats_and_families(spark):
    chunks = spark.createDataFrame([(1, "main", "main"), (1, "main", "main"), (2, "main", None), (3, "list", "list")], "doc_id long, collection string, wanted string")
    assert sorted(map(tuple, evaluation.collection_stats(chunks, F.col("wanted")).collect())) == [("list", 1, 1, 0), ("main", 3, 2, 1)]
    assert [tuple(r) for r in evaluation.invalid_chunks(chunks, F.col("wanted")).collect()] == [("main", 2)]
    hits = spark.createDataFrame([("q", 5, 1), ("r", 6, None), ("t", 7, None)], "question_id string, doc_id long, parent_doc_id long")
    expected = spark.createDataFrame([("q", 1), ("r", 1), ("s", 6)], "question_id string, doc_id long")
    assert sorted(map(tuple, evaluation.family_hits(hits, expected).collect())) == [("q", True), ("r", False), ("s", False)]


def test_relevance_and_account_kinds(spark):
    facts = "2024 年 3 月 报名 材料"
    rows = [
        ("转专业学生风采展示", facts, (False, "strong_exclude", "风采")),
        ("学术论坛", "", (False, "strong_exclude", "论坛")),
        ("推免政策讲座通知", facts, (True, "strong_include", "推免")),
        ("招生简章", "加油", (False, "no_facts", "")),
        ("校园一日", "领导出席并致辞 " + facts, (False, "news_noise", "出席+致辞")),
        ("追寻", "党员与党纪 " + facts, (False, "news_noise", "党建:党员+党纪")),
        ("开放日", facts, (False, "news_noise", "promotion")),
        ("校园一日", facts, (True, "neutral_pass", "")),
        ("校园一日", None, (True, "neutral_pass", "")),
    ]
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, b string").select("i", cascades.relevance(F.col("t"), F.col("b")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in got] == [r[2] for r in rows]
    kinds = {"一图读懂转专业": "procedure", "解读《学生管理办法》": "policy"}
    assert {t: one(spark, cascades.account_kind(F.col("t"), F.lit("")), t=t) for t in kinds} == kinds


def test_attachments_follow_their_best_parent(spark):
    schema = "doc_id long, document_type string, document_kind string, quality_status string, publish_date string, retention_status string, retention_reason string, series_key string, canonical_doc_id long"
    docs = spark.createDataFrame(
        [
            (1, "article", "policy", "accepted", "2020-01-01", "historical", "x", "s1", None),
            (2, "article", "policy", "accepted", "2019-01-01", "active", "x", "s2", 9),
            (3, "attachment", "form", "accepted", "unknown", "archived", "x", "s3", None),
            (4, "attachment", "news", "accepted", "unknown", "archived", "x", "s4", None),
            (5, "attachment", "form", "low_quality", "unknown", "archived", "x", "s5", None),
        ],
        schema,
    )
    edges = spark.createDataFrame([(1, 3), (2, 3), (2, 4), (2, 5), (77, 3)], "parent_doc_id long, child_doc_id long")
    got = {r.doc_id: (r.retention_status, r.series_key, r.canonical_doc_id) for r in catalog.retained_by_parent(docs, edges).collect()}
    assert got == {1: ("historical", "s1", None), 2: ("active", "s2", 9), 3: ("active", "s2", 9), 4: ("archived", "s4", None), 5: ("archived", "s5", None)}


def test_published_prefers_priority_and_sees_conflicts(spark):
    rows = [(1, 2, 0, "2020-01-01", 0.95), (1, 0, 1, "2021-01-01", 0.95), (2, 0, 1, "2020-01-01", 0.95), (2, 0, 0, "2022-01-01", 0.5)]
    got = catalog.published(spark.createDataFrame(rows, "doc_id long, priority int, pos int, date string, confidence double")).collect()
    assert sorted(map(tuple, got)) == [(1, "2021-01-01", True), (2, "2022-01-01", False)]


def test_web_functions_on_odd_values(spark):
    odd = spark.createDataFrame([(None,), ("",), (" x ",)], "c string")
    c = F.col("c")
    got = odd.select(
        web.slug(c).alias("slug"), web.account_url(c).alias("account"), web.next_list_page(c).alias("next"), web.next_page_query(c).alias("query"), web.viewer_target(c, F.lit("http://h/")).alias("viewer"), web.traceable(c).alias("traceable"),
        web.normal_date(c).alias("date"), web.file_date(c).alias("file"), web.revision_year(c).alias("year"), web.poor_title(c, ("x",)).alias("poor"), web.portal_kind(c, c).alias("portal"), web.total_pages(c).alias("pages"),
        web.url_name(c).alias("name"), web.client_key(c, c).alias("client"), web.topic_key(c, c, c, versions.policy_name).alias("topic"), web.strictly_newer(c, c).alias("newer"), web.epoch_date(F.lit(None).cast("long")).alias("day"),
    ).collect()
    assert [r.slug for r in got] == [None, "untitled", "x"] and all(r.next is None and r.query is None and r.viewer is None for r in got)
    assert all(r.account.startswith("https://mp.weixin.qq.com/") and not r.traceable and r.date == r.file == "unknown" and r.year is None and r.poor for r in got)
    assert all(r.portal == "generic" and r.pages == 0 and not r.newer and r.day == "1970-01-01" for r in got)
    assert [r.client for r in got] == ["unknown", "", "x"] and [r.topic for r in got] == ["unknown.topic", "unknown.topic", "x"]
    assert one(spark, web.slug(F.col("v")), v="Ａｂ　ｃ！") == "ab-c"
    assert one(spark, web.join_url(F.lit("http://h.x/a/b.htm?q=/z"), F.col("v")), v="c.pdf") == "http://h.x/a/c.pdf"


def test_guards_refuse_what_does_not_fit(spark):
    ids = spark.createDataFrame([(1,), (2,)], "question_id long")
    twice = spark.createDataFrame([(1, "answered"), (1, "refused")], "question_id long, status string")
    strange = spark.createDataFrame([(9, "answered")], "question_id long, status string")
    for answers in (twice, strange):
        with pytest.raises(ValueError):
            reports.merge_answers(ids, answers)
    for done in (twice, spark.createDataFrame([(1, "odd")], "question_id long, status string")):
        with pytest.raises(ValueError):
            reports.resumed(ids, done, ("answered", "refused"))
    with pytest.raises(Exception, match="unknown collection"):
        ids.select(reports.collection_names(F.lit("odd"), {"a": "b"})).collect()
    rates = spark.createDataFrame([(0, None, None, None), (3, None, 0.5, 1.0), (3, 0.9, None, 0.2)], "n int, hit_rate double, refusal_rate double, answer_rate double")
    assert [r.failures for r in reports.gate_failures(rates, 0.8, 0.8).collect()] == [["empty"], ["no_answerable", "refusal_rate"], ["no_refusable", "answer_rate"]]


def test_bm25_equals_a_plain_loop(spark):
    texts = {1: "red fox red", 2: "red hen", 3: None, 4: "", 5: "blue hen hen", 6: "owl"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(9, "Red red hen yak"), (8, ""), (7, None)], "question_id long, text string")
    held = {i: (t or "").split() for i, t in texts.items()}
    df = {w: sum(w in ws for ws in held.values()) for ws in held.values() for w in ws}
    idf = {w: np.log(len(texts) - n + 0.5) - np.log(n + 0.5) for w, n in df.items()}
    least = retrieval.EPSILON * np.mean(list(idf.values()))
    mean = sum(map(len, held.values())) / 5  # the null text has no length
    score = {}
    for i, ws in held.items():
        for w in ("red", "red", "hen"):
            tf, weight = ws.count(w), idf[w] if idf[w] >= 0 else least
            score[i] = score.get(i, 0) + weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean))
    got = {(r.question_id, r.doc_id): r.score for r in retrieval.bm25(docs, asked).collect()}
    assert got == pytest.approx({(9, i): s for i, s in score.items() if s > 0}, abs=1e-6)
    assert retrieval.bm25(docs.limit(0), asked).count() == 0


def test_attachment_kinds_and_packages(spark):
    word = files.word_file("T", ["a", " ", "b & <c>"], [["x", "y"], ["", ""]])
    assert attachments.parse("n.docx", word) == ("docx", "## T\na\nb & <c>\nx | y", 20, None, "ok", [])
    assert attachments.word_text(word, headings=False).startswith("T\na\nb")
    cell = lambda inner, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:r><w:t>{inner}</w:t></w:r></w:p></w:tc>"
    rows = f'<w:tr>{cell("w", "<w:gridSpan w:val=\'2\'/>")}{cell("v", "<w:vMerge w:val=\'restart\'/>")}</w:tr><w:tr>{cell("1")}{cell("2")}{cell("", "<w:vMerge/>")}</w:tr>'
    merged = files.package({"word/document.xml": f'<w:document xmlns:w="{files.WORD}"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:br/><w:t>b</w:t></w:r></w:p><w:tbl>{rows}</w:tbl></w:body></w:document>'})
    assert attachments.word_text(merged) == "a\t\nb\nw | w | v\n1 | 2 | v"
    sheet = files.sheet_file("s", ['<c r="A1" s="1"><v>0.5</v></c><c r="B1" s="1"><v>45000.25</v></c>', "<c><v>1E2</v></c><c><f>A1</f></c>", '<c r="B3" t="s"><v>0</v></c>', '<c r="B4" t="e"><v>#N/A</v></c>'], ("m",), ("B3:B4",))
    assert attachments.sheet_text(sheet) == ("## s\n12:00:00 | 2023-03-15T06:00:00\n100.0\n | m", 2, [])
    assert attachments.sheet_text(sheet, most=1)[2] == [attachments.NOTE_ROWS.format("s", 1)]
    assert attachments.sheet_text(sheet, large=1) == ("## s\n12:00:00 | 2023-03-15T06:00:00\n100.0\n | m\n | #N/A", 2, [attachments.NOTE_LARGE])
    assert [attachments.parse(n, c)[0::4] for n, c in ((None, None), ("a.xlsx", b"PK\x03\x04"), ("a", word), ("a.PDF", b""))] == [("unknown", "unsupported_format"), ("xlsx", "parse_failed"), ("docx", "ok"), ("pdf", "parse_failed")]
    rows = spark.createDataFrame([(1, "a.docx", bytearray(word)), (2, None, None)], "id long, name string, content binary")
    got = {r.id: r for r in attachments.parse_attachments(rows).collect()}
    assert (got[1].char_count, got[1].sheet_count, got[2].parse_status) == (20, None, "unsupported_format")
    assert attachments.parse_attachments(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        attachments.parse_attachments(rows.withColumn("text", F.lit("")))


def test_menus_need_a_menu_word_and_length():
    lines = [f"甲{i}" for i in range(9)]
    assert web._without_menus("\n".join(lines)) == "\n".join(lines)
    assert web._without_menus("\n".join(["校友", "甲", "乙"])) == "" and web._without_menus("校友\n甲") == "校友\n甲"
    assert web._without_menus("一。\n" + "\n".join([*lines, "导航"]) + "\n二。") == "一。\n二。" and web._without_menus("") == ""


def test_version_relations_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    names = ("本科生奖学金评审办法", "研究生选课管理规定", "校历")
    rows = []
    for i in range(160):
        n = names[rng.integers(3)]
        title = n + ("", "（2021年修订版）", "（试行）", "（修订）.pdf")[rng.integers(4)]
        body = ("无", "正文", f"自公布之日起施行，{n}同时废止", f"修订了{n}", f"{n}（试行）以本办法为准", None)[rng.integers(6)]
        date = ("unknown", None, *(f"20{y}-01-0{d}" for y in range(18, 24) for d in (1, 2)))[rng.integers(14)]
        rows.append((i, title, body, date, (n if rng.integers(3) else None), int(rng.integers(160)) if rng.integers(2) else None))
    rows.append((900, "独一无二的名称", "x", "2020-01-01", None, None))
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, publish_date string, policy_name string, parent_doc_id long")
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.when(of("policy_name") != "", F.col("policy_name")).otherwise(versions.policy_name(of("title")))
    keyed = docs.select("*", web.version_key(name, F.col("doc_id").cast("string")).alias("key"), F.regexp_replace(name, web.EXTENSION, "").alias("core")).toPandas()
    import re

    def proof(new, old):
        words = f"{new.title}\n{new.body or ''}"
        if len(old.core) >= 6 and old.core in words:
            found = [m.group(0) for p in versions.EVIDENCE if (m := re.search(p, words))] + (["修订" + old.core] if "修订" in words else [])
            if found:
                return "；".join(found)
        mark = re.search(versions.EDITION, new.title)
        return "标题版本标记：" + mark.group(0) if mark else ""

    want = set()
    for _, g in keyed.groupby("key"):
        g = sorted(g.itertuples(), key=lambda r: r.publish_date or "", reverse=True)
        used = set()
        for k, new in enumerate(g):
            for old in g[k + 1 :] if new.doc_id not in used else ():
                kin = new.doc_id == old.parent_doc_id or old.doc_id == new.parent_doc_id or new.parent_doc_id == old.parent_doc_id
                dates = [x.publish_date or "" for x in (new, old)]
                if old.doc_id in used or kin or not all(d.startswith("20") for d in dates) or dates[0] <= dates[1] or not (words := proof(new, old)):
                    continue
                want.add((new.doc_id, old.doc_id, words))
                used |= {new.doc_id, old.doc_id}
                break
        want |= {(r.doc_id, None, versions.UNKNOWN_EVIDENCE) for r in g if r.doc_id not in used and len(g) > 1}
    got = versions.version_relations(docs).collect()
    assert {(r.source_doc_id, r.target_doc_id, r.evidence) for r in got} == want and len(got) == len(want)
    assert sum(r.relation == "supersedes" for r in got) > 20
    assert versions.version_relations(docs.limit(0)).count() == 0


def test_nearest_equals_all_pairs_and_keeps_ties_in_order(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 8))
    v[100:300] = v[7]  # a large group of copies
    rows = [(f"c{i % 2}", f"k{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("c0", "zero", [0.0] * 8), ("c0", "null", None), ("c1", "hole", [1.0] * 7 + [None]), ("c1", "short", [1.0]), (None, "none", [1.0] * 8)]
    asked = [(i, f"c{i % 3}", v[i].tolist()) for i in range(40)] + [(99, "c0", None), (98, "c1", [2.0])]
    monkeypatch.setattr(retrieval, "TILE", 7)
    docs, q = spark.createDataFrame(rows, "c string, k string, vector array<double>"), spark.createDataFrame(asked, "question_id long, c string, vector array<double>")
    for most in (1000, 15):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        got = {(r.question_id, r["rank"]): (r.c, r.k, r.score) for r in retrieval.nearest(docs.repartition(3), q, 5, "c", "k", most).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = {(98, 1): ("c1", "short", 1.0)}
        for i, c, w in asked[:40]:
            mine = sorted((-round(float(np.dot(x, w) / np.sqrt(np.dot(x, x) * np.dot(w, w))), 9), k) for g, k, x in rows[:500] if g == c)
            want |= {(i, n + 1): (c, k, -s) for n, (s, k) in enumerate(mine[:5])}
        assert {a: b[:2] for a, b in got.items()} == {a: b[:2] for a, b in want.items()}
        assert all(abs(got[a][2] - want[a][2]) < 1.5e-9 for a in want)


def test_fact_signals_find_what_their_patterns_find(spark):
    """facts are searched by parts that they need; long words stay linear."""
    import random
    import re
    import time

    rnd = random.Random(19)
    bits = ["20", "2024", "年", "月", "日", "-", "12", "7", "138", "00138000", "0", "021", "6590", "4321", "a", "Q", "QQ", "@", ".", "cn", "http", "s", "://", "报", "名", "报名", "招", "生", " ", "\n", "校"]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(1, 14))) for _ in range(4000)] + [None, "", "3月5日", "2024 年", "x@y.cn", "@y.cn", "021-65901234"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cascades.fact_signals(F.col("t")).alias("f"), cascades.has_facts(F.col("t")).alias("e")).collect()
    want = {i: sorted(n for n, p in cascades.FACTS.items() if re.search(p, t or "", re.ASCII)) for i, t in enumerate(texts)}
    assert {r.i: r.f for r in got} == want and all(r.e == (len(r.f) >= 2) for r in got)
    assert {n for f in want.values() for n in f} == set(cascades.FACTS) and len({tuple(f) for f in want.values()}) > 8
    began = time.time()
    long = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 300_000), F.lit(" @")).alias("t"))
    assert long.select(cascades.fact_signals(F.col("t"))).first()[0] == []
    assert time.time() - began < 20


def test_trigram_vectors_of_many_texts_equal_a_plain_loop(spark):
    """grams are counted in numpy, and a long first line once for all texts that begin with it."""
    import hashlib
    import random
    import time

    rnd = random.Random(11)
    words = lambda n: "".join(rnd.choices("abc ÿéĀ报名😀\n", k=n))
    lines = ["".join(rnd.choices("xyz 校", k=n)) + "\n" for n in (126, 127, 128, 400)]
    texts = [words(rnd.randrange(30)) for _ in range(300)] + [x + words(n) for x in lines for n in (0, 1, 2, 3, 50, 0, 7)] + [None, "", "a", "ab", "abc", lines[3][:-1]]
    bucket = lambda g: hashlib.md5(g.encode(), usedforsecurity=False).digest()[-1] % 64
    for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(2).select("t", text.trigram_vector(F.col("t")).alias("v")).collect():
        if r.t is None:
            assert r.v is None
            continue
        counts = np.zeros(64)
        for i in range(max(1, len(r.t) - 2)):
            counts[bucket(r.t[i : i + 3])] += 1
        assert np.array_equal(r.v, counts / np.sqrt((counts * counts).sum())), r.t
    long = spark.range(0, 1000, 1, 1).select(F.concat(F.repeat(F.lit("abcdefghij "), 9000), F.lit("\n"), F.col("id").cast("string")).alias("t"))
    began = time.time()
    assert long.select(text.trigram_vector(F.col("t"))).distinct().count() > 1
    assert time.time() - began < 20


def test_bm25_meets_questions_in_tasks_and_equals_a_plain_sum(spark):
    """a common term makes no row for every pair of a question and a document."""
    import math
    import random

    rnd = random.Random(18)
    docs = [(i, " ".join(rnd.choices("the the of one two three four five six".split(), k=rnd.randrange(0, 12)))) for i in range(60)] + [(60, None)]
    asked = [(q, " ".join(rnd.choices("the of one two Seven six".split(), k=rnd.randrange(1, 5)))) for q in range(40)]
    found = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "question_id long, text string"), 5)
    assert "keys=[question_id" not in found._jdf.queryExecution().executedPlan().toString()
    words = {i: t.split() for i, t in docs if t is not None}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    mean = sum(map(len, words.values())) / len(words)
    want = []
    for q, t in asked:
        s = {i: sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in t.lower().split() if w in x) for i, x in words.items()}
        best = sorted(((-round(v, 6), i) for i, v in s.items() if round(v, 6) > 0))[:5]
        want += [(q, i, -v, r) for r, (v, i) in enumerate(best, 1)]
    got = sorted((r.question_id, r["rank"], r.doc_id, r.score) for r in found.collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(q, r, i) for q, i, _, r in sorted(want, key=lambda x: (x[0], x[3]))]
    assert np.allclose([x[3] for x in got], [x[2] for x in sorted(want, key=lambda x: (x[0], x[3]))], atol=2e-6)

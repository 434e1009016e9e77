"""Queries of the page, URL, name and date functions, with their SQL. Names begin with the handle of the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import web
from folioforge.operators import versions
from folioforge.plans import views
from folioforge.plans.registry import query
from folioforge.plans.views import SQL_CATALOG, table

#: Titles that rules of the real language meet, dealt to documents by id; the digits come from the id.
TITLES = (
    "关于印发《本科生国家奖学金评审办法（2023修订）》的通知", "2024年本科生奖学金评定通知", "本科生选课退课重修管理办法", "研究生选课须知（试行）", "家庭经济困难学生认定与困难认定细则",
    "关于2025年推荐免试推免工作的通知", "学位论文答辩与学位授予工作细则.docx", "硕博连读选拔办法（2021年修订版）", "校园网使用说明", "勤工助学管理规定的公告", "《》", "2022年度转专业转院系实施办法.pdf",
)
COLUMNS = ("奖学金专栏", "评优表彰", "推免信息", "就业指导", "本科招生网", "通知公告", "图片")


def _dealt(values: tuple[str, ...]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][doc_id % {len(values)} + 1]"


SQL_TITLED = f"titled AS (SELECT doc_id, {_sql_list(TITLES)} AS title, {_sql_list(COLUMNS)} AS name FROM documents)"


def _titled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _dealt(TITLES).alias("title"), _dealt(COLUMNS).alias("name"))


@query(
    r"""WITH s AS (SELECT doc_id, left(lower(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '[^\p{L}\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g')), 40) AS s FROM documents)
SELECT doc_id, regexp_replace(CASE WHEN s = '' THEN 'untitled' ELSE s END, '^-+|-+$', '', 'g') AS slug FROM s"""
)
def x02_slugs(spark, sf):
    return views.catalog(spark, sf).select("doc_id", web.slug(F.col("title")).alias("slug"))


@query(r"SELECT page_id, sha256(regexp_replace(html, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', '', 'g')) AS page_hash, 'sha256:' || sha256(html) AS binary_hash FROM pages")
def x23_page_hashes(spark, sf):
    """X-23, X-27."""
    return table(spark, sf, "pages").select("page_id", web.page_hash(F.col("html")).alias("page_hash"), web.binary_hash(F.col("html").cast("binary")).alias("binary_hash"))


SQL_ACCOUNT = r"""a AS (SELECT page_id, 'http://Host.example/s/t' || page_id || CASE WHEN page_id % 4 = 0 THEN '/' ELSE '' END || '?scene=1&__biz=b' || page_id || '&Chksm=z&x=' || CASE WHEN page_id % 3 = 0 THEN '&flag' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '#rd' ELSE '' END AS url FROM pages)"""


def _accounts(spark, sf):
    i = F.col("page_id")
    on = lambda k, x: F.when(i % k == 0, x).otherwise("")
    url = F.concat(F.lit("http://Host.example/s/t"), i.cast("string"), on(4, "/"), F.lit("?scene=1&__biz=b"), i.cast("string"), F.lit("&Chksm=z&x="), on(3, "&flag"), on(5, "#rd"))
    return table(spark, sf, "pages").select("page_id", url.alias("url"))


@query(f"WITH {SQL_ACCOUNT} SELECT page_id, 'https://mp.weixin.qq.com/s/t' || page_id || '?__biz=b' || page_id || '&x=' || CASE WHEN page_id % 3 = 0 THEN '&flag=' ELSE '' END AS account_url FROM a")
def x31_account_urls(spark, sf):
    return _accounts(spark, sf).select("page_id", web.account_url(F.col("url")).alias("account_url"))


@query(
    f"""WITH {SQL_ACCOUNT} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://mp.weixin.qq.com/s?__biz=B' || page_id || '&mid=7&idx=1'
  ELSE 'https://mp.weixin.qq.com/s/t' || page_id || '?__biz=b' || page_id || '&x=' || CASE WHEN page_id % 3 = 0 THEN '&flag=' ELSE '' END END AS identity FROM a"""
)
def x32_account_identities(spark, sf):
    biz = F.concat(F.lit(" B"), F.col("page_id").cast("string"))
    return _accounts(spark, sf).select("page_id", web.account_identity(F.col("url"), biz, F.when(F.col("page_id") % 2 == 0, "7"), F.lit("1")).alias("identity"))


@query(
    r"""WITH u AS (SELECT page_id, 'http://h.example/a/' || ['list', 'Index', 'default', 'news'][page_id % 4 + 1] || CASE WHEN page_id % 3 = 0 THEN '' ELSE CAST(page_id % 50 AS VARCHAR) END || '.htm' AS url, 'http://h.example/q?k=1&pageNo=' || (page_id % 90) || '&z=2' AS query FROM pages)
SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'http://h.example/a/' || ['list', 'Index', 'default'][page_id % 4 + 1] || CASE WHEN page_id % 3 = 0 THEN 2 ELSE page_id % 50 + 1 END || '.htm' END AS next_list,
  CASE WHEN page_id % 5 > 0 THEN 'http://h.example/q?k=1&pageNo=' || (page_id % 90 + 1) || '&z=2' END AS next_query FROM u"""
)
def x34_next_pages(spark, sf):
    """X-34: list pages and page parameters."""
    i = F.col("page_id")
    stem = F.element_at(F.array(*map(F.lit, ("list", "Index", "default", "news"))), (i % 4 + 1).cast("int"))
    listed = F.concat(F.lit("http://h.example/a/"), stem, F.when(i % 3 == 0, "").otherwise((i % 50).cast("string")), F.lit(".htm"))
    asked = F.when(i % 5 > 0, F.concat(F.lit("http://h.example/q?k=1&pageNo="), (i % 90).cast("string"), F.lit("&z=2"))).otherwise("http://h.example/q?k=1")
    return table(spark, sf, "pages").select("page_id", web.next_list_page(listed).alias("next_list"), web.next_page_query(asked).alias("next_query"))


@query("SELECT page_id, 'http://h.example/list.htm' || CASE WHEN page_id % 2 = 0 THEN '?a=1&' ELSE '?' END || 'source_attachment=' || left(sha256(url), 16) AS parent FROM pages")
def x37_synthetic_parents(spark, sf):
    listed = F.when(F.col("page_id") % 2 == 0, "http://h.example/list.htm?a=1").otherwise("http://h.example/list.htm")
    return table(spark, sf, "pages").select("page_id", web.synthetic_parent(listed, F.col("url")).alias("parent"))


@query(
    """SELECT page_id, ['http://h.example/f/a ' || page_id || '.pdf', 'https://o.example/x+' || page_id || '.doc', 'http://h.example/v/b' || page_id || '.xls', NULL][page_id % 4 + 1] AS target FROM pages"""
)
def x38_viewer_targets(spark, sf):
    i = F.col("page_id").cast("string")
    made = F.array(
        F.concat(F.lit("<script>var _fileUrl = '/f/a%20"), i, F.lit(".pdf'</script>")), F.concat(F.lit('DEFAULT_URL: "https://o.example/x+'), i, F.lit('.doc"')),
        F.concat(F.lit("<a href='viewer.html?file=b"), i, F.lit(".xls&x'>")), F.col("html"),
    )
    return table(spark, sf, "pages").select("page_id", web.viewer_target(F.element_at(made, (F.col("page_id") % 4 + 1).cast("int")), F.lit("http://h.example/v/page.htm?x=/y")).alias("target"))


@query("SELECT page_id, page_id % 4 IN (0, 1) AS traceable FROM pages")
def x39_traceable(spark, sf):
    made = F.array(F.concat(F.lit(" "), "url"), F.concat(F.lit("HTTPS://"), F.col("page_id").cast("string")), F.lit("ftp://x/y"), F.lit("http://"))
    return table(spark, sf, "pages").select("page_id", web.traceable(F.element_at(made, (F.col("page_id") % 4 + 1).cast("int"))).alias("traceable"))


SQL_YMD = "2015 + doc_id % 11 AS y, doc_id % 15 AS m, doc_id % 34 AS d"


@query(
    f"""WITH x AS (SELECT doc_id, {SQL_YMD} FROM documents) SELECT doc_id, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN format('{{}}-{{:02d}}-{{:02d}}', y, m, d) ELSE 'unknown' END AS date,
  CASE WHEN doc_id % 3 > 0 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN format('{{}}-{{:02d}}-{{:02d}}', y, m, d) ELSE 'unknown' END AS labelled FROM x"""
)
def x40_dates(spark, sf):
    """X-40, X-42."""
    i = F.col("doc_id")
    y, m, d = (c.cast("string") for c in (2015 + i % 11, i % 15, i % 34))
    written = F.when(i % 2 == 0, F.concat(y, F.lit(" 年"), m, F.lit("月 "), d, F.lit("日"))).otherwise(F.concat(y, F.lit("/"), m, F.lit("/"), d))
    label = F.when(i % 3 > 0, F.concat(F.lit("点击 1999-01-01 发布时间："), written)).otherwise(F.concat(F.lit("时间："), written))
    return table(spark, sf, "documents").select("doc_id", web.normal_date(written).alias("date"), web.labelled_date(label).alias("labelled"))


@query(
    f"""WITH x AS (SELECT doc_id, {SQL_YMD} FROM documents), t AS (SELECT *, format('{{}}{{:02d}}{{:02d}}', y, m, d) AS raw FROM x)
SELECT doc_id, coalesce(strftime(try_strptime(raw, '%Y%m%d'), '%Y-%m-%d'), 'unknown') AS date, CASE WHEN doc_id % 2 = 0 THEN y END AS revised FROM t"""
)
def x46_file_dates(spark, sf):
    i = F.col("doc_id")
    title = F.concat(F.format_string("%d%02d%02d", 2015 + i % 11, i % 15, i % 34), F.lit(" 办法（"), F.when(i % 2 == 0, F.concat((2015 + i % 11).cast("string"), F.lit("年第二次修订"))).otherwise("修订"), F.lit("）"))
    return table(spark, sf, "documents").select("doc_id", web.file_date(title).alias("date"), web.revision_year(title).alias("revised"))


@query(f"WITH {SQL_CATALOG} SELECT c.doc_id, c.publish_date <> 'unknown' AND p.publish_date <> 'unknown' AND c.publish_date > p.publish_date AS newer FROM catalog c JOIN catalog p ON c.parent_doc_id = p.doc_id")
def x47_strictly_newer(spark, sf):
    c = views.catalog(spark, sf).select("doc_id", "parent_doc_id", "publish_date")
    p = c.select(F.col("doc_id").alias("parent_doc_id"), F.col("publish_date").alias("older"))
    return c.join(p, "parent_doc_id").select("doc_id", web.strictly_newer(F.col("publish_date"), F.col("older")).alias("newer"))


@query("SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day FROM events")
def x48_epoch_days(spark, sf):
    seconds = F.unix_seconds(F.from_utc_timestamp(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"), "UTC"))
    return table(spark, sf, "events").select("event_id", web.epoch_date(seconds).alias("day"))


@query(f"WITH {SQL_CATALOG}, t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Index ' WHEN 1 THEN left(sha256(text), 9) WHEN 2 THEN '' ELSE 'a' || title END AS t, doc_id % 4 < 3 AS poor FROM catalog) SELECT doc_id, poor FROM t")
def p09_poor_titles(spark, sf):
    t = F.element_at(F.array(F.lit(" Index "), F.left(F.sha2("text", 256), F.lit(9)), F.lit(""), F.concat(F.lit("a"), "title")), (F.col("doc_id") % 4 + 1).cast("int"))
    return views.catalog(spark, sf).select("doc_id", web.poor_title(t, ("index", "untitled", "default")).alias("poor"))


@query(
    """SELECT page_id, ['wp3', 'gs_home', 'gs_home', 'generic'][page_id % 4 + 1] AS portal, page_id % 3 = 0 AS pager, CASE WHEN page_id % 2 = 0 THEN page_id % 70 + 1 ELSE 0 END AS n_pages FROM pages"""
)
def p34_portals(spark, sf):
    """P-34, P-37, Y-38: marks of portals, script pagers and page numbers."""
    i = F.col("page_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (i % 4 + 1).cast("int"))
    html = F.concat("html", pick("<div class='WP_paging'>", "", "<a href='/Home/Detail/3'>", ""), F.when(i % 3 == 0, "<a onclick = \"x(); goPage(2)\">").otherwise(""))
    html = F.concat(html, F.when(i % 2 == 0, F.concat(F.lit("共 1 页 共"), (i % 70 + 1).cast("string"), F.lit(" 页"))).otherwise(""))
    url = F.concat(F.lit("http://h.example"), pick("/Home/List/1", "/Home/List/77", "/", "/Home/"))
    return table(spark, sf, "pages").select("page_id", web.portal_kind(html, url).alias("portal"), web.script_pager(html).alias("pager"), web.total_pages(html).alias("n_pages"))


@query(f"WITH {SQL_TITLED} SELECT doc_id, ['奖助学金', '评奖评优', '推免升学', '实习就业', '学工事务', '学工事务', '其他'][doc_id % 7 + 1] AS category FROM titled")
def p35_categories(spark, sf):
    return _titled(spark, sf).select("doc_id", web.column_category(F.col("name")).alias("category"))


@query(f"""WITH {SQL_TITLED} SELECT doc_id, ['undergraduate.scholarship.merit', 'undergraduate.scholarship.merit', 'undergraduate.course_selection', 'graduate.course_selection', 'undergraduate.financial_aid.need_assessment',
  'undergraduate.recommendation_exemption', 'graduate.degree_thesis', 'graduate.integrated_master_doctor', '校园网使用说明', 'undergraduate.work_study', '《》', 'undergraduate.major_transfer'][doc_id % 12 + 1] AS topic_key FROM titled""")
def x05_topics(spark, sf):
    return _titled(spark, sf).select("doc_id", web.topic_key(F.col("title"), F.lit(""), F.lit(None).cast("string"), versions.policy_name).alias("topic_key"))


@query(f"""WITH {SQL_TITLED} SELECT doc_id, ['本科生国家奖学金评审办法', '本科生奖学金评定', '本科生选课退课重修管理办法', '研究生选课须知', '家庭经济困难学生认定与困难认定细则', '推荐免试推免工作', '学位论文答辩与学位授予工作细则', '硕博连读选拔办法', '校园网使用说明',
  '勤工助学管理规定的', '《》', '转专业转院系实施办法'][doc_id % 12 + 1] AS version_key FROM titled""")
def x08_version_keys(spark, sf):
    """X-04, X-08."""
    return _titled(spark, sf).select("doc_id", web.version_key(versions.policy_name(F.col("title")), F.col("doc_id").cast("string")).alias("version_key"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', '', 'g') <> ''), chr(10)) AS text FROM documents")
def x10_counters(spark, sf):
    counter = F.when(F.col("doc_id") % 2 == 0, "\n 阅读量：12 \n\n").otherwise("\n点击数 7")
    return table(spark, sf, "documents").select("doc_id", web.without_counters(F.concat("text", counter)).alias("text"))


@query(
    f"""WITH {SQL_CATALOG} SELECT c.doc_id, sha256('# f' || c.doc_id || '.pdf' || chr(10) || chr(10) || '所属通知：' || p.title || chr(10) || '发布日期：' || p.publish_date || chr(10) || '发布单位：' || p.source || chr(10) || '原发布页：http://h.example/' || p.doc_id
  || chr(10) || '附件下载地址：http://h.example/f/' || c.doc_id || chr(10) || chr(10) || '## 附件正文' || chr(10) || chr(10) || c.text || chr(10)) AS digest FROM catalog c JOIN catalog p ON c.parent_doc_id = p.doc_id"""
)
def x20_attachment_texts(spark, sf):
    c = views.catalog(spark, sf)
    p = c.select(F.col("doc_id").alias("parent_doc_id"), F.col("title").alias("p_title"), F.col("publish_date").alias("p_date"), F.col("source").alias("p_source"))
    i, j = F.col("doc_id").cast("string"), F.col("parent_doc_id").cast("string")
    made = web.attachment_text(F.concat(F.lit("f"), i, F.lit(".pdf")), F.col("p_title"), F.col("p_date"), F.col("p_source"), F.concat(F.lit("http://h.example/"), j), F.concat(F.lit("http://h.example/f/"), i), F.col("text"))
    return c.join(p, "parent_doc_id").select("doc_id", F.sha2(made, 256).alias("digest"))


@query("SELECT page_id, ['10.0.0.' || (page_id % 9), 'peer', 'unknown', 'peer'][page_id % 4 + 1] AS client FROM pages")
def y35_client_keys(spark, sf):
    i = F.col("page_id") % 4
    forwarded = F.when(i == 0, F.concat(F.lit(" 10.0.0."), (F.col("page_id") % 9).cast("string"), F.lit(" , 10.1.1.1"))).when(i == 1, "")
    return table(spark, sf, "pages").select("page_id", web.client_key(forwarded, F.when(i != 2, "peer")).alias("client"))


@query("SELECT page_id, 'A b ' || page_id || '.pdf' AS title, 'x y' || page_id AS name FROM pages")
def y40_file_names(spark, sf):
    i = F.col("page_id").cast("string")
    attribute = F.concat(F.lit("{'id':'1','title' : ' A  b "), i, F.lit(".pdf'}"))
    return table(spark, sf, "pages").select("page_id", web.file_title(attribute).alias("title"), web.url_name(F.concat(F.lit("http://h.example/a/x%20y"), i, F.lit(".docx/?q=1.z"))).alias("name"))


@query("SELECT doc_id, CASE WHEN contains(text, 'idiot') THEN 'idiot' WHEN contains(text, '###') THEN '###' WHEN contains(text, 'tion') THEN 'tion' ELSE '' END AS word FROM documents")
def y53_first_keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", web.first_keyword(F.col("text"), ("idiot", "###", "tion")).alias("word"))


MENU = ("首页", "学院简介", "师资队伍", "科学研究", "招生", "校历")
SQL_MENU = "'" + "' || chr(10) || '".join(MENU) + "'"


@query(
    f"""SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '招生' || chr(10) || '首页' || chr(10) || '校历' || chr(10) || '章程' || chr(10) ELSE '' END || '正文。' || chr(10) || text || chr(10) || '完。'
|| CASE doc_id % 6 WHEN 4 THEN chr(10) || {SQL_MENU} || chr(10) || '止。' ELSE '' END AS text FROM documents"""
)
def p38_menu_lines(spark, sf):
    """P-38: menus before (six lines go, four stay), after (three lines), in one line, in the middle (six stay, eight go)."""
    i, block, line = F.col("doc_id") % 6, "\n".join(MENU), " ".join((*MENU, "a", "b"))
    before = F.when(i == 0, block + "\n").when(i == 1, "招生\n首页\n校历\n章程\n").when(i == 3, line + "\n").otherwise("")
    after = F.when(i == 2, "\n招生\n 首页\n校历").when(i == 4, f"\n{block}\n止。").when(i == 5, f"\n{block}\na\nb").otherwise("")
    return table(spark, sf, "documents").select("doc_id", web.without_menus(F.concat(before, F.lit("正文。\n"), "text", F.lit("\n完。"), after)).alias("text"))

"""Column functions for URLs, page marks, names and dates of crawled pages. All stay inside the JVM but ``nfkc`` and ``without_menus``."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions.text import collapse, squash, strip

# Parameters that do not tell articles apart, and the host of account articles.
TRACKING = ("scene", "chksm", "nwr_flag", "xtrack", "subscene", "clicktime", "enterid")
ACCOUNT_HOST = "mp.weixin.qq.com"
# Patterns of list pages, page parameters, pagers, viewers, file names and counters.
LIST_PAGE = r"^(.*/)((?i)list|index|default)(\d*)\.((?i)htm|html|shtml)((?:[?#].*)?)$"
PAGE_PARAMETER = r"(?i)([?&](?:page|p|pageNo|pageIndex|currentPage)=)(\d+)(?=&|#|$)"
SCRIPT_PAGER = r"""(?i)createPageHTML|_showDynClickBatch|onclick\s*=\s*["'][^"']*goPage|data-page|loadPage\s*\("""
TOTAL_PAGES = r"共\s*(\d+)\s*页"
VIEWER = (r"""(?i)_fileurl\s*=\s*['"]([^'"]+)['"]""", r"""(?i)DEFAULT_URL\s*[=:]\s*['"]([^'"]+)['"]""", r"""(?i)viewer(?:\.html)?\?file=([^'"\s&]+)""")
PORTAL = r"(?i)wp_articlecontent|wp_paging|wp_listcolumn|createPageHTML|/_upload/"
HOME = r"/Home/(?:List|Detail)/\d+"
COUNTER = r"(?m)^\s*(?:阅读量|浏览量|阅读数|浏览次数|点击数|访问量)\s*[:：]?\s*\d+\s*$"
DATE = r"(20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"
DATE_LABEL = r"(?:发布日期|发布时间|发稿时间)\s*[:：]?\s*(20\d{2}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2})"
REVISION = r"((?:19|20)\d{2})\s*年[^）\n]{0,12}修订"
FILE_TITLE = r"'title'\s*:\s*'([^']+)'"
HASH_NAME = r"(?i)^[0-9a-f]{8,}$"
# Columns by pattern, first match first.
CATEGORIES = (
    ("奖学金|助学金|奖助|勤工助学|助学贷款", "奖助学金"), ("评奖评优|评优|表彰", "评奖评优"), ("推免|保研|研究生推荐|免试", "推免升学"), ("就业|实习|招聘|生涯|职业", "实习就业"),
    ("招生|本科招生|研究生招生", "学工事务"), ("通知|规章|制度|培养|教学|学生|办事|下载|公示|教务|政策", "学工事务"),
)
# Topics by the terms that all occur, first match first.
TOPICS = (
    (("本科生", "奖学金"), "undergraduate.scholarship.merit"),
    (("国家奖学金",), "undergraduate.scholarship.national"),
    (("国家励志奖学金",), "undergraduate.scholarship.incentive"),
    (("助学金", "资助"), "undergraduate.financial_aid"),
    (("困难认定", "家庭经济困难"), "undergraduate.financial_aid.need_assessment"),
    (("勤工助学",), "undergraduate.work_study"),
    (("推免", "推荐免试"), "undergraduate.recommendation_exemption"),
    (("选课", "退课", "重修"), "undergraduate.course_selection"),
    (("休学", "复学", "退学"), "undergraduate.enrollment_status"),
    (("转专业", "转院系"), "undergraduate.major_transfer"),
    (("校外学习学分", "成绩转换"), "undergraduate.external_credit_transfer"),
    (("研究生", "选课"), "graduate.course_selection"),
    (("学分认定",), "graduate.credit_recognition"),
    (("学位论文", "答辩", "学位授予"), "graduate.degree_thesis"),
    (("博士", "申请考核"), "graduate.doctoral_application_assessment"),
    (("硕博连读",), "graduate.integrated_master_doctor"),
    (("国际交流", "公派留学", "短期交流"), "student.international_exchange"),
)
# What is cut from a name before topics and versions are compared.
TOPIC_NOISE = "20\\d{2}年|20\\d{2}年度|（[^）]*(?:修订|试行|暂行)[^）]*）"
VERSION_NOISE = "（[^）]*(?:修订|试行|暂行)[^）]*）|(?:19|20)\\d{2}\\s*年(?:度)?"
EXTENSION = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?)$"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Text in compatibility form; no built-in does it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def slug(title: Column, most: int = 40) -> Column:
    """Lower-case name of letters, digits, ``_`` and ``-``, cut to ``most`` characters; ``untitled`` where nothing is left."""
    s = F.lower(F.regexp_replace(F.regexp_replace(nfkc(title), r"[^\p{L}\p{N}_-]+", "-"), "^-+|-+$", ""))
    s = F.left(s, F.lit(most))
    return F.regexp_replace(F.when(s == "", "untitled").otherwise(s), "^-+|-+$", "")


def page_hash(html: Column) -> Column:
    """Digest of a page without white space."""
    return F.sha2(squash(html), 256)


def binary_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def account_url(url: Column) -> Column:
    """Stable form of an account article's URL: https, one host, no fragment, no tracking parameters. Values keep their encoding."""
    bare = F.regexp_replace(strip(_or_empty(url)), "#.*$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    query = F.array_join(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.concat(F.lit(f"https://{ACCOUNT_HOST}"), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def account_identity(url: Column, biz: Column, mid: Column, idx: Column) -> Column:
    """The URL made of the three identity values where all are there, else :func:`account_url`."""
    b, m, i = (strip(_or_empty(c)) for c in (biz, mid, idx))
    made = F.concat(F.lit(f"https://{ACCOUNT_HOST}/s?__biz="), b, F.lit("&mid="), m, F.lit("&idx="), i)
    return F.when((b != "") & (m != "") & (i != ""), made).otherwise(account_url(url))


def next_list_page(url: Column) -> Column:
    """``list.htm`` to ``list2.htm``, ``list3.htm`` to ``list4.htm``; null for other pages."""
    part = lambda k: F.regexp_extract(url, LIST_PAGE, k)
    number = F.when(part(3) == "", F.lit(2)).otherwise(F.try_to_number(part(3), F.lit("999999999")).cast("long") + 1).cast("string")
    return F.when(part(2) != "", F.concat(part(1), part(2), number, F.lit("."), part(4), part(5)))


def next_page_query(url: Column) -> Column:
    """The URL with its first page parameter raised by one; null without one."""
    number = F.try_to_number(F.regexp_extract(url, PAGE_PARAMETER, 2), F.lit("999999999")).cast("long") + 1
    head = F.regexp_extract(url, rf"^(.*?){PAGE_PARAMETER}(.*)$", 1)
    tail = F.regexp_extract(url, rf"^(.*?){PAGE_PARAMETER}(.*)$", 4)
    return F.when(url.rlike(PAGE_PARAMETER), F.concat(head, F.regexp_extract(url, PAGE_PARAMETER, 1), number.cast("string"), tail))


def synthetic_parent(list_url: Column, attachment_url: Column) -> Column:
    """A parent page's URL for an attachment that a list links to directly: the list with a digest of the attachment's URL."""
    bare, mark = F.regexp_replace(list_url, "#.*$", ""), F.regexp_extract(list_url, "(#.*)$", 1)
    token = F.concat(F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("source_attachment="), F.left(F.sha2(attachment_url, 256), F.lit(16)))
    return F.concat(bare, token, mark)


def join_url(base: Column, target: Column) -> Column:
    """An absolute URL from a page's and a link: absolute links as they are, ``/`` from the host, others from the page's folder."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^?#]*)?)", 1)
    folder = F.when(folder == "", "/").otherwise(F.regexp_replace(folder, "[^/]*$", ""))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(F.startswith(target, F.lit("/")), F.concat(origin, target)).otherwise(F.concat(origin, folder, target))


def viewer_target(html: Column, base: Column) -> Column:
    """The file that a viewer page shows, by the first pattern that matches; null without one."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(_or_empty(html), p, 1), F.lit("")) for p in VIEWER))
    return join_url(base, F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def traceable(url: Column) -> Column:
    return strip(_or_empty(url)).rlike(r"(?i)^https?://[^/?#]+")


def normal_date(text: Column) -> Column:
    """The first date of a text in ISO form, months 1 to 12 and days 1 to 31; else ``unknown``."""
    part = [F.try_to_number(F.regexp_extract(_or_empty(text), DATE, k), F.lit("9999")).cast("int") for k in (1, 2, 3)]
    ok = part[1].between(1, 12) & part[2].between(1, 31)
    return F.when(ok, F.format_string("%04d-%02d-%02d", *part)).otherwise("unknown")


def labelled_date(text: Column) -> Column:
    """The date after the first label of a publication date; ``unknown`` without one."""
    return normal_date(F.regexp_extract(_or_empty(text), DATE_LABEL, 1))


def file_date(title: Column) -> Column:
    """The date that eight leading digits give; ``unknown`` where they give none."""
    raw = F.regexp_extract(_or_empty(title), r"^((?:19|20)\d{6})", 1)
    return F.coalesce(F.date_format(F.try_to_date(F.when(raw != "", raw), "yyyyMMdd"), "yyyy-MM-dd"), F.lit("unknown"))


def revision_year(title: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(_or_empty(title), REVISION, 1), F.lit("")), F.lit("9999")).cast("int")


def strictly_newer(a: Column, b: Column) -> Column:
    """Whether date text ``a`` is later than ``b``; false where one does not begin with a full date."""
    dated = r"^\d{4}-\d{2}-\d{2}"
    return _or_empty(a).rlike(dated) & _or_empty(b).rlike(dated) & F.coalesce(a > b, F.lit(False))


def epoch_date(seconds: Column) -> Column:
    """The UTC day of a second; null and 0 are the first day of 1970."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.coalesce(seconds, F.lit(0)) / 86_400).cast("int")), "yyyy-MM-dd")


def poor_title(title: Column, generic: tuple[str, ...]) -> Column:
    t = strip(_or_empty(title))
    return (t == "") | t.rlike(HASH_NAME) | F.lower(t).isin(*generic)


def portal_kind(html: Column, url: Column) -> Column:
    h = _or_empty(html)
    return F.when(h.rlike(PORTAL), "wp3").when(h.rlike(HOME) | _or_empty(url).rlike(HOME), "gs_home").otherwise("generic")


def column_category(name: Column) -> Column:
    c = F.when(name.rlike(CATEGORIES[0][0]), CATEGORIES[0][1])
    for pattern, category in CATEGORIES[1:]:
        c = c.when(name.rlike(pattern), category)
    return c.otherwise("其他")


def script_pager(html: Column) -> Column:
    return _or_empty(html).rlike(SCRIPT_PAGER)


def total_pages(html: Column) -> Column:
    """The largest number of pages that a pager tells; 0 without one."""
    found = F.transform(F.regexp_extract_all(_or_empty(html), F.lit(TOTAL_PAGES), F.lit(1)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("long"))
    return F.coalesce(F.array_max(found), F.lit(0).cast("long"))


def without_counters(text: Column) -> Column:
    """Text without lines of view counts and without blank lines."""
    lines = F.split(F.regexp_replace(text, COUNTER, ""), "\n")
    return F.array_join(F.filter(lines, lambda x: strip(x) != ""), "\n")


def file_title(attribute: Column) -> Column:
    return collapse(F.regexp_extract(_or_empty(attribute), FILE_TITLE, 1))


def url_name(url: Column) -> Column:
    """The decoded last part of a URL's path without its extension."""
    path = F.regexp_replace(F.regexp_extract(_or_empty(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    name = F.try_url_decode(F.replace(F.regexp_extract(path, "([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    return strip(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""))


def client_key(forwarded: Column, host: Column) -> Column:
    """The first hop of a forwarding header, else the peer, else ``unknown``."""
    return F.when(_or_empty(forwarded) != "", F.trim(F.split(forwarded, ",")[0])).otherwise(F.coalesce(host, F.lit("unknown")))


def first_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """The first word of the list that the text holds; empty without one."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words), F.lit(""))


def topic_key(title: Column, policy: Column, unit: Column, name_of) -> Column:
    """The topic of the first rule whose terms all occur; else the name by ``name_of`` without years and edition marks, else ``unknown.topic``."""
    text = squash(F.concat(*(_or_empty(c) for c in (title, policy, unit))))
    found = F.lit(None).cast("string")
    for terms, key in reversed(TOPICS):
        every = F.contains(text, F.lit(terms[0]))
        for t in terms[1:]:
            every = every & F.contains(text, F.lit(t))
        found = F.when(every, key).otherwise(found)
    name = F.regexp_replace(name_of(F.when(_or_empty(policy) != "", policy).otherwise(_or_empty(title))), TOPIC_NOISE, "")
    return F.coalesce(found, F.nullif(name, F.lit("")), F.lit("unknown.topic"))


def version_key(name: Column, otherwise: Column) -> Column:
    """A policy name without extension, years and edition marks; ``otherwise`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, EXTENSION, ""), VERSION_NOISE, ""), "^[ ：:，,。]+|[ ：:，,。]+$", "")
    return F.when(bare != "", bare).otherwise(otherwise)


def attachment_text(name: Column, parent_title: Column, date: Column, publisher: Column, page_url: Column, file_url: Column, text: Column) -> Column:
    """An attachment's document: its name, what it belongs to and where it lay, then its text."""
    return F.concat(
        F.lit("# "), name, F.lit("\n\n所属通知："), parent_title, F.lit("\n发布日期："), date, F.lit("\n发布单位："), publisher, F.lit("\n原发布页："), page_url,
        F.lit("\n附件下载地址："), file_url, F.lit("\n\n## 附件正文\n\n"), text, F.lit("\n"),
    )


#: What a menu line looks like, words of institutional menus, and the least lines of a menu block by place.
MENU_LINE = r"[^\s。，；：、！？.,;:!?()（）《》【】\[\]{}]{1,15}"
MENU_WORDS = r"首页|English|信息门户|邮箱|师资队伍|导航|关注我们|扫码|校友|学院简介|科学研究|本科生培养|研究生培养|组织机构|学院领导|党建工作|新闻中心|通知公告"
MENU_HEAD, MENU_TAIL, MENU_MIDDLE = 5, 3, 8


def _menu_row(line: str) -> bool:
    """A whole menu in one line: at least eight words, seven in ten of at most six characters, one of them a menu word."""
    words = line.split()
    return len(words) >= 8 and 10 * sum(len(w) <= 6 for w in words) >= 7 * len(words) and re.search(MENU_WORDS, line) is not None


def _without_menus(text: str) -> str:
    lines = text.split("\n")
    lines = [x for i, x in enumerate(lines) if not ((i < 4 or i >= len(lines) - 2) and _menu_row(x.strip()))]
    kept, at = [], 0
    for short, run in itertools.groupby(lines, lambda x: re.fullmatch(MENU_LINE, x.strip()) is not None):
        run = list(run)
        first, at = at == 0, at + len(run)
        least = MENU_TAIL if at == len(lines) else MENU_HEAD if first else MENU_MIDDLE
        if not (short and len(run) >= least and any(re.search(MENU_WORDS, x) for x in run)):
            kept += run
    return "\n".join(kept)


@F.pandas_udf(StringType())
def without_menus(texts: pd.Series) -> pd.Series:
    """Text without menu blocks: runs of short lines without punctuation that hold a menu word, and menus in one line. Null stays null."""
    return texts.map(lambda t: None if t is None else _without_menus(t))

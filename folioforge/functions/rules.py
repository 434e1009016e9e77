"""Rule packs as data, and the ordered cascades that are generated from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import squash, strip


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def cascade(rules: list[tuple[Column, str | Column]], default: str | bool | Column | None) -> Column:
    """The value of the first rule that holds. A null condition does not hold."""
    out = F.lit(default) if not rules else None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default) if rules else out


#: Kinds of documents and the collections that serve them.
MAIN_KINDS = ("policy", "procedure", "faq", "annual_notice", "form", "manual", "service_guide")
HISTORICAL_KINDS = ("policy", "procedure", "annual_notice", "form", "manual", "service_guide")
TIME_BOUND_KINDS = ("annual_notice", "public_list", "news", "event", "promotion")
ENDURING_KINDS = ("policy", "procedure", "faq", "form", "manual", "service_guide")
BOOSTS = {"policy": 1.1, "notice": 1.1, "procedure": 1.1, "announcement": 1.1, "download_template": 1.1, "news": 0.85, "event": 0.85}


def collection_of(kind: Column, retention: Column) -> Column:
    k = F.lower(strip(F.coalesce(F.nullif(kind, F.lit("")), F.lit("incomplete"))))
    r = F.lower(strip(F.coalesce(F.nullif(retention, F.lit("")), F.lit("archived"))))
    return cascade([((r == "historical") & k.isin(*HISTORICAL_KINDS), "historical"), (r != "active", None), (k.isin(*MAIN_KINDS), "main_qa"), (k == "public_list", "public_list")], None)


def boost(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in BOOSTS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, kind), F.lit(1.0))


def temporal_class(kind: Column) -> Column:
    k = F.lower(strip(F.coalesce(kind, F.lit(""))))
    return cascade([(k.isin(*ENDURING_KINDS), "enduring"), (k == "annual_notice", "annual"), (k == "public_list", "recurring_public"), (k.isin("news", "event", "promotion"), "ephemeral")], "undated")


@dataclass(frozen=True)
class QualityPack:
    """Words and limits of the quality rules."""

    attachment_hints: tuple[str, ...]
    footer_words: tuple[str, ...]
    generic_titles: tuple[str, ...]
    punctuation: str = r"[。，；：、！？.,;:!?()（）《》【】\[\]{}．]"
    attachment_body: int = 120
    least_body: int = 80
    informative_title: int = 12
    short_line: int = 15
    short_ratio: float = 0.6
    least_lines: int = 10
    footer_hits: int = 4
    reasons: dict = field(default_factory=dict)


#: The quality words for Chinese pages.
ZH_QUALITY = QualityPack(
    attachment_hints=("详见附件", "附件如下", "点击下载", "请下载", "见附件", "附表", "附："),
    footer_words=("备案号", "沪ICP备", "邮编", "地址：", "电话：", "版权所有"),
    generic_titles=(
        "首页", "通知公告", "欢迎访问", "无标题", "untitled", "index", "default", "管理规定", "规章制度", "新闻动态", "学院新闻", "图片新闻", "最新动态",
        "综合新闻", "招生信息", "信息公开", "下载专区", "办事指南", "机构设置", "联系我们", "公示公告", "公告公示", "公示专栏", "硕士生招生",
    ),
)
#: Words that occur in the synthetic tables.
DEMO_QUALITY = QualityPack(attachment_hints=("the",), footer_words=("###", "$$$", "%%%", "&&&"), generic_titles=("eron.", "erinst resh."), footer_hits=3)


def quality_reasons(title: Column, body: Column, attachment: Column, date: Column, kind: Column, p: QualityPack) -> Column:
    """Codes of all rules that a document breaks, in rule order."""
    t, size = strip(title), F.length(squash(body))
    lines = F.filter(F.transform(F.split(body, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: (F.length(x) <= p.short_line) & ~x.rlike(p.punctuation)))
    footers = sum((F.when(body.contains(w), 1).otherwise(0) for w in p.footer_words[1:]), F.when(body.contains(p.footer_words[0]), 1).otherwise(0))
    hashy = t.rlike(r"^[0-9a-f]{8,}$")
    generic = F.lower(t).isin(*p.generic_titles)
    informative = (F.length(t) >= p.informative_title) & ~hashy & ~generic
    rules = [
        ((size < p.attachment_body) & any_of(body, p.attachment_hints) & ~attachment, "needs_attachment"),
        (t == "", "empty_title"),
        ((t != "") & hashy, "hash_title"),
        ((t != "") & ~hashy & generic, "generic_title"),
        ((F.size(lines) >= p.least_lines) & (kind != "service_guide") & (short / F.size(lines) > p.short_ratio), "navigation"),
        (footers >= p.footer_hits, "footer"),
        ((size < p.least_body) & ~attachment & ~(informative & (date != "unknown")), "short_body"),
    ]
    return F.array_compact(F.array(*(F.when(c, name) for c, name in rules)))


def quality_status(reasons: Column) -> Column:
    return cascade([(F.array_contains(reasons, "needs_attachment"), "incomplete_document"), (F.size(reasons) > 0, "low_quality")], "accepted")


def quality_score(reasons: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.25) * F.size(reasons))


@dataclass(frozen=True)
class TypePack:
    """Ordered (type, words) over title and body; ``list_type`` also needs so many nonblank lines."""

    rules: tuple[tuple[str, tuple[str, ...]], ...]
    list_type: str = "public_list"
    list_lines: int = 20


#: Words of document types, first match wins.
ZH_TYPES = TypePack(
    (
        ("policy", ("办法", "规定", "条例", "章程", "实施细则", "管理办法")),
        ("procedure", ("流程", "指南", "须知", "办理", "操作手册")),
        ("public_list", ("名单", "公示")),
        ("announcement", ("公告", "通知")),
        ("download_template", ("下载", "模板", "表格", "申请表")),
        ("event", ("讲座", "活动", "比赛", "竞赛", "报名开始")),
        ("news", ("新闻", "动态", "举行", "召开", "走访", "调研")),
    )
)
DEMO_TYPES = TypePack((("policy", ("keit", "pathetic")), ("procedure", ("ción",)), ("public_list", (" | ", "!!")), ("announcement", ("eau",)), ("event", ("###",)), ("news", ("tion",))), list_lines=3)


def document_type(title: Column, body: Column, p: TypePack) -> Column:
    text = F.concat(title, F.lit("\n"), body)
    lines = F.size(F.filter(F.split(body, "\r\n|[\n\r]"), lambda x: strip(x) != ""))
    return cascade([(any_of(text, w) & (lines >= p.list_lines) if t == p.list_type else any_of(text, w), t) for t, w in p.rules], "unknown")


#: Personal numbers and internal addresses.
ID_NUMBER = r"(?<!\d)(\d{17}[\dXx])(?!\d)"
PHONE = r"(?<!\d)(1[3-9]\d{9})(?!\d)"
LONG_NUMBER = r"(?<!\d)(\d{16})(?!\d)"
ADDRESS = r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])"


def sensitive(text: Column, patterns: tuple[str, ...]) -> Column:
    """All matches of the patterns, by pattern and then in text order."""
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns)))

"""Ordered cascades over title and body: kinds, admission levels, topics, facts, dates and evidence.

A pack holds the words; the order of the rules is the order of the lists here. All rules are built-in
expressions, so a cascade adds no shuffle and no Python to a scan. A null title or body counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.rules import any_of, cascade
from folioforge.functions.text import strip

REFUSED = ("incomplete_document", "low_quality", "quarantined", "rejected")


@dataclass(frozen=True)
class KindPack:
    """Words of the document kinds. ``wrapper`` and ``year`` are patterns for titles."""

    wrapper: str
    year: str
    public_list: tuple[str, ...]
    news_name: str
    news_unit: str
    bulletin: str
    promotion: tuple[str, ...]
    event: tuple[str, ...]
    news: tuple[str, ...]
    annual: tuple[str, ...]
    faq: tuple[str, ...]
    policy: tuple[str, ...]
    first_article: str
    form: tuple[str, ...]
    manual: tuple[str, ...]
    service: tuple[str, ...]
    procedure: tuple[str, ...]
    notice: tuple[str, ...]
    head: int = 500
    form_body: int = 300


#: The words of document kinds for Chinese pages.
ZH_KINDS = KindPack(
    wrapper=r"关于印发《[^》]*(?:办法|规定|细则|条例|章程)[^》]*》(?:的)?通知",
    year=r"(?:19|20)\d{2}(?:\s*[-—至/]\s*(?:19|20)\d{2})?\s*(?:年|年度|学年)?",
    public_list=("名单", "公示"),
    news_name="新闻",
    news_unit="新闻与",
    bulletin="动态",
    promotion=("宣讲会", "招生宣传", "开放日", "分享团", "活动回顾"),
    event=("讲座", "论坛", "会议预告", "比赛", "竞赛"),
    news=("新闻", "动态", "召开", "走访", "调研", "活动"),
    annual=("通知", "公告", "报名", "评选", "评审", "招生", "推免", "复试", "调剂", "录取", "申请", "选拔", "考核", "报到", "安排", "奖学金", "助学金", "资助", "夏令营"),
    faq=("常见问题", "常见问答", "FAQ", "问答"),
    policy=("办法", "规定", "条例", "章程", "实施细则", "管理办法"),
    first_article="第一条",
    form=("申请表", "登记表", "审批表", "表格", "模板"),
    manual=("操作手册", "使用手册", "用户手册"),
    service=("服务说明", "服务指南", "服务介绍", "服务流程"),
    procedure=("流程", "指南", "办理", "须知"),
    notice=("通知", "公告"),
)
#: Words that occur in the synthetic tables.
DEMO_KINDS = KindPack(
    wrapper=r"^[A-Z][a-z]+ung ", year=r"[0-9]{4}", public_list=(" | ",), news_name="keit", news_unit="keit ", bulletin="###", promotion=("$$$",), event=("%%%",), news=("schaft", "&&&"), annual=("e", "a"),
    faq=("???",), policy=("ción", "dad "), first_article=". ", form=("eau",), manual=("!!",), service=("@",), procedure=("heit", "ment "), notice=("tion",),
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def document_kind(title: Column, body: Column, status: Column, attachment: Column, p: KindPack = ZH_KINDS) -> Column:
    """The kind of a document by title first, then by its words; refused documents are ``incomplete``."""
    title, body = _text(title), _text(body)
    either = lambda words: any_of(title, words) | any_of(body, words)
    unit, head = title.contains(p.news_unit), F.substring(body, 1, p.head)
    return cascade(
        [
            (status.isin(*REFUSED), "incomplete"),
            (title.rlike(p.wrapper), "policy"),
            (any_of(title, p.public_list), "public_list"),
            ((title.contains(p.news_name) & ~unit) | title.contains(p.bulletin), "news"),
            (any_of(title, p.promotion), "promotion"),
            (any_of(title, p.event), "event"),
            (any_of(title, p.news) & ~unit, "news"),
            (title.rlike(p.year) & any_of(title, p.annual), "annual_notice"),
            (either(p.faq), "faq"),
            (any_of(title, p.policy) | (head.contains(p.first_article) & any_of(head, p.policy)), "policy"),
            (either(p.form) & (F.length(strip(body)) < p.form_body), "form"),
            (either(p.manual), "manual"),
            (either(p.service), "service_guide"),
            (either(p.procedure), "procedure"),
            (any_of(title, p.notice), "annual_notice"),
            (F.coalesce(attachment, F.lit(False)), "manual"),
        ],
        "incomplete",
    )


@dataclass(frozen=True)
class AdmissionPack:
    """Patterns of the admission levels; those named ``_body`` look at the head of the body."""

    intent: str
    declared: str
    non_degree: str
    grants_body: str
    recommend: str
    camp: str
    camp_for: str
    reexamination: str
    adjustment: str
    doctoral: str
    doctoral_body: str
    master: str
    master_body: str
    undergraduate: str
    weak: str
    head: int = 1500
    camp_head: int = 400


#: Patterns of admission levels for Chinese pages.
ZH_ADMISSION = AdmissionPack(
    intent="招生|报名|录取|推免|预推免|推荐免试|调剂|复试|夏令营|申请考核|选拔|招录|选调|简章|申报",
    declared="非学历教育|非学历培训",
    non_degree="非学历教育|非学历培训|课程培训班|高级研修班|研修班|专题培训|证书项目|培训项目|继续教育学院|结业证书|课程班",
    grants_body="授予[^。]{0,8}(?:学士|硕士|博士)学位|颁发[^。]{0,8}(?:硕士|博士|本科)[^。]{0,4}(?:毕业证书|学位证书)|获得[^。]{0,8}学位证书",
    recommend="推免|推荐免试|预推免|接收推免",
    camp="夏令营",
    camp_for="推免|硕士|研究生|选拔|录取",
    reexamination="复试",
    adjustment="调剂",
    doctoral="博士研究生|博士学位|博士招生|申请考核|直博",
    doctoral_body="博士研究生招生|博士学位研究生|博士招生|申请考核制|直接攻读博士",
    master="硕士研究生|硕士学位|专业学位硕士|研究生招生|全国硕士研究生|MPAcc|MAud|MBA|EMBA|MF(?![A-Za-z])|金融硕士|会计硕士|审计硕士",
    master_body="硕士研究生(?:招生|考试)|硕士学位研究生|硕士专业学位|专业学位硕士|全国硕士研究生|MPAcc|MAud|MBA|EMBA|金融硕士|会计硕士|审计硕士",
    undergraduate="本科招生|本科生招生|普通本科|高考|本科录取|本科新生|招生计划",
    weak="招生|报名|录取",
)
DEMO_ADMISSION = AdmissionPack(
    intent="[aeiou]n", declared="###", non_degree="keit|ción", grants_body="tion[^.]{0,8}e", recommend="heit", camp="ment", camp_for="eau", reexamination="schaft", adjustment="ung ",
    doctoral="ique", doctoral_body="ent ", master="able", master_body="ous ", undergraduate="ir|el", weak="e",
)


def admission_level(title: Column, body: Column, p: AdmissionPack = ZH_ADMISSION) -> Column:
    """The admission level of a document; empty where its title shows no intent to admit anyone."""
    title, head = _text(title), F.substring(_text(body), 1, p.head)
    shows = lambda at_title, at_body: title.rlike(at_title) | head.rlike(at_body)
    master = shows(p.master, p.master_body)
    camp = title.rlike(p.camp) & F.concat(title, F.substring(head, 1, p.camp_head)).rlike(p.camp_for)
    return cascade(
        [
            (~title.rlike(p.intent), ""),
            (head.rlike(p.declared) | (title.rlike(p.non_degree) & ~head.rlike(p.grants_body)), "non_degree_program"),
            (title.rlike(p.recommend) | camp, "recommendation_admission"),
            (title.rlike(p.reexamination), "reexamination"),
            (title.rlike(p.adjustment), "adjustment"),
            (shows(p.doctoral, p.doctoral_body) & ~master, "doctoral_admission"),
            (master, "master_admission"),
            (shows(p.undergraduate, p.undergraduate), "undergraduate_admission"),
            (title.rlike(p.weak), "other_admission"),
        ],
        "",
    )


#: Topics by admission level, then by words.
LEVEL_TOPICS = {
    "recommendation_admission": "推免/预推免", "reexamination": "复试/调剂", "adjustment": "复试/调剂", "doctoral_admission": "博士招生", "master_admission": "硕士招生",
    "undergraduate_admission": "本科招生", "non_degree_program": "非学历项目", "other_admission": "其他招生",
}
ZH_TOPICS = (
    ("推免/预推免", ("推免", "预推免", "推荐免试", "直博", "硕博连读")),
    ("夏令营", ("夏令营", "优秀大学生")),
    ("复试/调剂", ("复试", "调剂")),
    ("博士招生", ("博士", "申请考核")),
    ("硕士招生", ("硕士", "MPAcc", "MAud", "MBA", "研究生招生")),
    ("转专业", ("转专业", "专业分流", "专业选择")),
    ("实验班/选拔", ("实验班", "拔尖班", "卓越班", "创新班", "校内选拔", "二次选拔", "双学位", "辅修", "选拔")),
    ("国际项目", ("国际项目", "联合培养", "交换", "暑校", "3+1", "2+2", "海外", "国际组织")),
    ("招生宣传", ("亮点", "宣传", "开放日", "宣讲", "招生季")),
)
OTHER_TOPIC = "其他"
DEMO_TOPICS = (("one", ("ción",)), ("two", ("eau", "ique")), ("three", ("tion", "ness")))


def topic(title: Column, body: Column, level: Column, rules=ZH_TOPICS, preview: int = 400) -> Column:
    """The topic of a known admission level, else of the first words found in the title, else in the body's preview."""
    by_level = [(level == k, v) for k, v in LEVEL_TOPICS.items()]
    places = (_text(title), F.substring(_text(body), 1, preview))
    return cascade(by_level + [(any_of(c, words), name) for c in places for name, words in rules], OTHER_TOPIC)


#: Patterns of facts that can be cited.
FACTS = {
    "date": r"20\d{2}\s*年|20\d{2}-\d{2}-\d{2}|\d{1,2}\s*月\s*\d{1,2}\s*日",
    "number": r"\d{2,}",
    "contact": r"1[3-9]\d{9}|0\d{2,3}-?\d{7,8}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|QQ|https?://",
    "action": "报名|申请|条件|材料|对象|方式|考核|复试|调剂|录取|资格|选拔|学费|学制|名单|咨询|联系|提交|审核|计划|专业|招生|推免|报考|时间|地点",
}


#: What each pattern comes to where only its presence is asked: words are searched as they are, and patterns only where a part that they need is there.
_CJK = r"(?=[\u4e00-\u9fff])"
_DATE, _DAY = r"20\d{2}(?:\s*年|-\d{2}-\d{2})", r"\d\s*月\s*\d{1,2}\s*日"
_PHONE, _MAIL = r"1[3-9]\d{9}|0\d{2,3}-?\d{7}", r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2}"


def _facts(t: Column) -> dict[str, Column]:
    """Whether a text holds each of :data:`FACTS`."""
    has, number = lambda *words: any_of(t, words), t.rlike(r"\d\d")
    return {
        "date": (number & t.rlike(_DATE)) | (has("月") & has("日") & t.rlike(_DAY)),
        "number": number,
        "contact": has("QQ", "http://", "https://") | (number & t.rlike(_PHONE)) | (has("@") & t.rlike(_MAIL)),
        "action": t.rlike(f"{_CJK}(?:{FACTS['action']})"),
    }


def fact_signals(body: Column) -> Column:
    """Names of the kinds of facts in a text, sorted."""
    held = _facts(_text(body))
    return F.array_compact(F.array(*(F.when(held[name], name) for name in sorted(held))))


def has_facts(body: Column, least: int = 2) -> Column:
    return F.size(fact_signals(body)) >= least


def date_gate(date: Column, forced: Column, earliest: str = "2024-01-01") -> Column:
    """``reason`` and whether a publish date is ``open``; unknown dates are let through and seen to later."""
    d = strip(_text(date))
    reason = cascade([(forced, "force_include"), (d.isin("", "unknown"), "unknown_date"), (d < earliest, "too_old")], "in_window")
    return F.struct((reason != "too_old").alias("open"), reason.alias("reason"))


def article_url(url: Column, host: str, path: str = "/s") -> Column:
    """Whether a URL names an article of the host: http or https, and a path that begins with ``path``."""
    part = lambda k: F.regexp_extract(strip(_text(url)), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", k)
    return F.lower(part(1)).isin("http", "https") & (F.lower(part(2)) == host) & part(3).startswith(path)


#: Words of an answer that refuses for want of evidence.
EVIDENCE_WORDS = ("资料", "依据", "文档", "来源")
MISSING_WORDS = ("未提及", "未明确提及", "未找到", "没有找到", "无法确定", "无法从")


def evidence_refusal(answer: Column, evidence: tuple[str, ...] = EVIDENCE_WORDS, missing: tuple[str, ...] = MISSING_WORDS, stop: str = "。") -> Column:
    """Whether the first sentence of an answer's first paragraph says that the sources lack what was asked."""
    paragraph = F.regexp_extract(strip(_text(answer)), r"(?s)^(.*?)(?:\n\s*\n|\z)", 1)
    first = F.substring_index(paragraph, stop, 1)
    return any_of(first, evidence) & any_of(first, missing)


def trim_lines(body: Column) -> Column:
    """Text without blanks and tabs before line ends."""
    return F.regexp_replace(body, r"[ \t]+(?=\n|\z)", "")


#: Words of a wanted point, and the pattern that is evidence for it; the first row that fits counts.
ZH_POINTS = (
    (("材料", "证明", "清单", "凭证"), r"材料|证明|清单|表格|附件|凭证"),
    (("流程", "步骤", "程序", "手续"), r"流程|步骤|程序|手续|办理"),
    (("条件", "资格", "要求", "规则", "范围", "标准"), r"条件|资格|要求|规则|范围|标准"),
    (("时间", "截止", "期限", "有效期", "时段", "安排"), r"时间|截止|日期|期限|有效|时段|\d{1,2}\s*月"),
    (("部门", "科室", "单位", "办公室", "审核", "审批", "受理", "经办", "指导"), r"教务处|学生处|研究生院|学院|部门|科室|办公室|中心|处|所"),
    (("联系", "咨询", "电话", "地址", "地点", "渠道", "反馈", "报告"), r"联系|咨询|电话|邮箱|地址|地点|渠道|反馈"),
    (("对象",), r"对象|适用于|面向"),
    (("入口", "系统", "方式", "下载", "平台", "绑定", "激活", "认证"), r"入口|系统|平台|网站|下载|登录|办理|激活|认证"),
    (("费用", "收费", "资助标准"), r"费用|收费|金额|免费|元"),
)
DEMO_POINTS = ((("a", "q"), "[0-9]{3}"), (("er",), "@|###"))


def point_supported(body: Column, point: Column, rules=ZH_POINTS) -> Column:
    """Whether a text has evidence for a point: the point itself, or the pattern of its class."""
    body = _text(body)
    return body.contains(point) | cascade([(any_of(point, words), body.rlike(pattern)) for words, pattern in rules], False)


#: Kinds that an answer may rest on.
GROUND_KINDS = ("policy", "procedure", "faq", "annual_notice", "form", "manual", "service_guide")


def grounding(status: Column, hits: Column, missing: Column, year: int, least: float = 0.55, keep: int = 2, age: int = 3) -> Column:
    """``status, doc_ids, reason`` of a probed question.

    ``hits`` is an array of ``doc_id, similarity, document_kind, publish_date`` in rank order. An answerable question
    whose best hit is similar enough rests on its first documents of a fitting kind; annual notices must be recent.
    """
    hits = F.filter(F.coalesce(hits, F.array()), lambda h: h["similarity"].isNotNull())
    best = F.coalesce(F.get(hits, 0)["similarity"], F.lit(0.0))
    published = lambda h: F.try_to_number(F.regexp_extract(_text(h["publish_date"]), r"^(20\d{2})", 1), F.lit("9999")).cast("int")
    fit = lambda h: h["document_kind"].isin(*GROUND_KINDS) & ((h["document_kind"] != "annual_notice") | F.coalesce(published(h) >= year - age, F.lit(False)))
    ids = F.slice(F.array_distinct(F.transform(F.filter(hits, fit), lambda h: h["doc_id"])), 1, keep)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.coalesce(h["document_kind"], F.lit("?"))))), "、")
    reason = cascade(
        [
            (status == "not_answerable", F.coalesce(F.get(missing, 0), F.lit("无高置信检索结果"))),
            (status != "answerable", F.concat(F.lit("probe 状态 "), status, F.lit("，待复核"))),
            ((F.size(hits) == 0) | (best < least), F.concat(F.lit("top 相似度 "), F.format_string("%.2f", best), F.lit(f" 低于固化线 {least}"))),
            (F.size(ids) == 0, F.concat(F.lit("命中文档类型不足以作为依据（"), kinds, F.lit("）"))),
        ],
        "",
    )
    return F.struct(F.when(reason == "", "grounded").otherwise("needs_docs").alias("status"), F.when(reason == "", ids).otherwise(F.slice(ids, 1, 0)).alias("doc_ids"), reason.alias("reason"))


@dataclass(frozen=True)
class RelevancePack:
    """Words that keep or reject an article, by title and then by the preview of its body."""

    exclude: tuple[str, ...]
    soft: tuple[str, ...]
    include: tuple[str, ...]
    signal: tuple[str, ...]
    news: tuple[str, ...]
    party: tuple[str, ...]
    noise: tuple[str, ...] = ("news", "event", "promotion")
    party_label: str = "党建:"
    preview: int = 600
    markers: int = 2


#: Words of relevance for Chinese articles.
ZH_RELEVANCE = RelevancePack(
    exclude=(
        "喜报", "喜讯", "精彩回顾", "活动回顾", "风采", "讲座", "论坛", "党建", "主题党日", "校友", "人物专访", "专访", "学术活动", "学术讲座", "比赛", "获奖", "赛事", "精彩瞬间", "节日",
        "教师招聘", "学院新闻", "晚会", "典礼", "剪影", "纪实", "打卡", "投票", "摄影", "征集令", "招募令", "军训", "运动会", "文艺", "演出", "展览", "参访", "研讨会", "成功举办", "圆满举办",
        "顺利举行", "圆满落幕", "落幕", "收官", "一等奖", "二等奖", "国赛", "夺冠", "金奖", "论文入选", "论文发表", "成果速递", "顶会", "诚邀全球英才", "诚邀海内外英才", "英才加盟", "招聘公告",
        "结项", "党课", "党支部", "党委",
    ),
    soft=("讲座", "论坛"),
    include=(
        "推免", "预推免", "推荐免试", "直博", "硕博连读", "优秀大学生", "夏令营", "申请考核", "博士招生", "硕士招生", "复试", "调剂", "招生简章", "招生", "报考", "报名", "申请", "实验班", "拔尖班",
        "卓越班", "创新班", "转专业", "专业分流", "双学位", "辅修", "选拔", "国际项目", "联合培养", "指南", "办理", "流程", "办法", "细则", "通知", "常见问题", "faq", "FAQ", "选课", "奖学金",
        "助学金", "新生", "报到", "须知", "安排", "公示",
    ),
    signal=("推免", "预推免", "夏令营", "招生", "报名", "申请", "复试", "调剂", "选拔", "转专业", "实验班", "报考", "录取", "简章", "通知"),
    news=("召开", "举行", "出席", "致辞", "走访", "调研", "座谈", "合影", "开幕式", "闭幕式"),
    party=("党支部", "党员", "党课", "党委", "主题党日", "八项规定", "廉洁", "红色记忆", "党纪", "入党"),
)
DEMO_RELEVANCE = RelevancePack(exclude=("###", "keit", "$$"), soft=("keit",), include=("tion", "eau"), signal=("ung",), news=("heit", "ung", "ment"), party=("ción", "dad", "ento"))


def _found(c: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def relevance(title: Column, body: Column, p: RelevancePack = ZH_RELEVANCE, kinds: KindPack = ZH_KINDS) -> Column:
    """``keep, reason, matched`` of an article. An empty body is judged by its title alone."""
    title, body = strip(_text(title)), _text(body)
    preview = F.substring(body, 1, p.preview)
    excluded, included = (F.coalesce(F.get(_found(title, words), 0), F.lit("")) for words in (p.exclude, p.include))
    plain, read = included == "", body != ""
    news, party = _found(preview, p.news), _found(preview, p.party)
    kind = document_kind(title, preview, F.lit("accepted"), F.lit(False), kinds)
    listed = lambda words: F.array_join(F.array_sort(words), "+")
    made = lambda reason, matched: F.struct(F.lit(reason in ("strong_include", "neutral_pass")).alias("keep"), F.lit(reason).alias("reason"), matched.alias("matched"))
    return cascade(
        [
            ((excluded != "") & (~excluded.isin(*p.soft) | (plain & ~any_of(title, p.signal))), made("strong_exclude", excluded)),
            (read & plain & kind.isin(*p.noise), made("news_noise", kind)),
            (read & plain & (F.size(news) >= p.markers), made("news_noise", listed(news))),
            (read & plain & (F.size(party) >= p.markers), made("news_noise", F.concat(F.lit(p.party_label), listed(party)))),
            (read & ~has_facts(body), made("no_facts", F.array_join(fact_signals(body), ","))),
            (~plain, made("strong_include", included)),
        ],
        made("neutral_pass", F.lit("")),
    )


#: Titles that explain a policy, and titles that name one.
EXPLAINS, NAMES_POLICY = "一图读懂|图解|解读|释义|问答|热点问答", "《[^》]*(?:办法|规定|细则|条例|章程)[^》]*》"


def account_kind(title: Column, body: Column, explains: str = EXPLAINS, names: str = NAMES_POLICY, p: KindPack = ZH_KINDS) -> Column:
    """The kind of an account's article: what explains a policy is a procedure, all else by ``document_kind``."""
    title = strip(_text(title))
    return F.when(title.rlike(explains) & ~title.rlike(names), "procedure").otherwise(document_kind(title, body, F.lit("accepted"), F.lit(False), p))

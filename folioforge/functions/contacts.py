"""Personal numbers in texts, with the context that makes a telephone number a public one. All inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.rules import PHONE, any_of
from folioforge.functions.text import squash

#: A personal number anywhere, words of public and of private contacts, and how many characters before a number count.
PERSON = r"(\d{17}[\dXx])"
PUBLIC = (
    "联系电话", "咨询电话", "招生咨询", "报名咨询", "项目咨询", "咨询老师", "联系老师", "招生办公室", "招生办", "项目办公室", "学院办公室", "办公室电话", "联系方式", "联系我们", "咨询邮箱", "电子邮箱", "咨询：", "手机：", "电话：", "电话:",
)
PRIVATE = ("紧急联系人", "家庭电话", "家庭住址", "家长", "亲属", "本人身份证", "银行卡")
WINDOW = 60


def public_context(before: Column) -> Column:
    """Whether the characters before a number name a public contact and no private one."""
    near = squash(before)
    return ~any_of(near, PRIVATE) & any_of(near, PUBLIC)


def phones(text: Column) -> Column:
    """Array of (number, before): telephone numbers in order with up to ``WINDOW`` characters before each, earlier numbers included."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(1))
    # the pieces between numbers; only the last WINDOW characters are carried from one number to the next
    pairs = F.arrays_zip(F.slice(F.split(text, PHONE, -1), F.lit(1), F.size(found)).alias("piece"), found.alias("number"))
    last = lambda *c: F.right(F.concat(*c), F.lit(WINDOW))
    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<struct<number:string,before:string>>").alias("out"))
    walk = lambda acc, x: F.struct(last(acc["tail"], x["piece"], x["number"]).alias("tail"), F.array_append(acc["out"], F.struct(x["number"].alias("number"), last(acc["tail"], x["piece"]).alias("before"))).alias("out"))
    return F.aggregate(pairs, start, walk, lambda acc: acc["out"])


def personal(text: Column, allow_phone: Column, allow_public: Column) -> Column:
    """The numbers for which a text is held back: personal numbers whatever the source, then telephone numbers unless the source may show
    them all, or may show public ones and the context is public. Null flags count as false; a null text has none."""
    people = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PERSON), F.lit(1))
    open_ = F.coalesce(allow_public, F.lit(False))
    private = F.filter(phones(text), lambda p: ~(open_ & public_context(p["before"])))
    return F.concat(people, F.when(F.coalesce(allow_phone, F.lit(False)), F.array().cast("array<string>")).otherwise(F.transform(private, lambda p: p["number"])))

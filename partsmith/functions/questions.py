"""Reading codes, levels and target texts out of questions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from partsmith.functions.text import is_blank, jtrim

# How codes, levels, listings and look-alike requests are written.
_CN_DIGITS = "一二三四五六七八九"
_CODE = r"\d{2,6}"
_LEVEL_BEFORE = r"(\d{1,2})\s*级"
_LEVEL_AFTER = r"层级\s*(\d{1,2})"
_LEVEL_CN = r"([一二三四五六七八九])级"
_LISTING = ("有哪些", "有什么", "全部分类", "所有分类", "列举", "列出", "都有什么", "查询全部", "全部标准")
_LIKE_WORDS = "相似|类似|相近|差不多"
_LIKE_LABELLED = rf"(?:{_LIKE_WORDS})\s*(?:物料|材料|产品)\s*[:：]\s*(.+)"
_LIKE_AS = rf"[和跟与同]\s*(.+?)\s*(?:{_LIKE_WORDS})"
_LEAD_WORDS = (
    "请|帮(?:我)?|麻烦|我想|我想问|请问|推荐|找|查询|查|给我|列举|列出|有哪些|有啥|啥|哪些|"
    "相似|类似|相近|差不多|物料|材料|产品|推荐相似|类似"
)


def levels_in(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    spelled = F.transform(
        F.regexp_extract_all(text, F.lit(_LEVEL_CN), F.lit(1)),
        lambda d: F.translate(d, _CN_DIGITS, "123456789"),
    )
    found = F.concat(
        F.regexp_extract_all(text, F.lit(_LEVEL_BEFORE), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_LEVEL_AFTER), F.lit(1)),
        spelled,
    )
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: d.cast("int"))))


def codes_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_CODE), F.lit(0)))


def without_codes(c: Column) -> Column:
    return jtrim(F.regexp_replace(c, _CODE, " "))


def is_listing(c: Column) -> Column:
    hit = F.lit(False)
    for word in _LISTING:
        hit = hit | F.contains(c, F.lit(word))
    return hit


def similar_target(c: Column) -> Column:
    """The description a question asks look-alikes for."""
    text = jtrim(c)
    rest = jtrim(F.regexp_replace(text, f"(?:{_LEAD_WORDS})", " "))
    return (
        F.when(is_blank(c), F.lit(""))
        .when(text.rlike(_LIKE_LABELLED), jtrim(F.regexp_extract(text, _LIKE_LABELLED, 1)))
        .when(text.rlike(_LIKE_AS), jtrim(F.regexp_extract(text, _LIKE_AS, 1)))
        .otherwise(rest)
    )

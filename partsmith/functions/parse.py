"""Description text to ordered key/value items, as one array expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from partsmith.config import ParseRule
from partsmith.functions.text import jtrim, let


def _literal(sep: str) -> str:
    return re.escape(sep)


def parse_desc(c: Column, rule: ParseRule = ParseRule()) -> Column:
    """``array<struct<pos,key,value>>``: a repeated key keeps its first place and last value.

    The escape character is resolved after the text has been cut into items, so
    by default it does not protect an item separator; ``strict_escape`` makes
    it do so.
    """
    text = F.coalesce(c, F.lit(""))
    item_sep = _literal(rule.item_sep)
    if rule.escape and rule.strict_escape:
        item_sep = f"(?<!{_literal(rule.escape)}){item_sep}"
    items = F.split(text, item_sep, -1)

    if not rule.ignore_empty:
        # Empty pieces at the end never count as items, those in between do here.
        items = F.split(F.regexp_replace(text, f"(?:{item_sep})+$", ""), item_sep, -1)
    if rule.trim:
        items = F.transform(items, jtrim)
    if rule.ignore_empty:
        items = F.filter(items, lambda x: x != "")
    if rule.escape:
        items = F.transform(
            items,
            lambda x: F.replace(
                F.replace(x, F.lit(rule.escape + rule.item_sep), F.lit(rule.item_sep)),
                F.lit(rule.escape + rule.kv_sep), F.lit(rule.kv_sep),
            ),
        )

    sep = F.lit(rule.kv_sep)

    def as_pair(x: Column) -> Column:
        at = F.instr(x, sep)
        key = F.when(at > 0, jtrim(F.substring(x, F.lit(1), at - 1))).otherwise(F.lit(""))
        value = F.when(at > 0, jtrim(F.substring(x, at + len(rule.kv_sep), F.length(x)))).otherwise(jtrim(x))
        return F.struct(key.alias("key"), value.alias("value"))

    def numbered(pairs: Column) -> Column:
        return F.transform(pairs, lambda p, i: F.struct(i.cast("int").alias("pos"), p["key"].alias("key"), p["value"].alias("value")))

    def last_wins(pairs: Column) -> Column:
        """Sorted by key and place, so each key is one run: its first place, its last value."""
        by_key = F.sort_array(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))))

        def runs(s: Column) -> Column:
            firsts = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"]))
            lasts = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["key"] != x["key"]))
            found = F.zip_with(firsts, lasts, lambda f, x: F.struct(f["at"].alias("at"), f["key"].alias("key"), x["value"].alias("value")))
            return numbered(F.sort_array(found))

        return let(by_key, runs)

    def ordered(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        return F.when(F.size(keys) == F.size(pairs), numbered(pairs)).otherwise(last_wins(pairs))

    return let(F.transform(items, as_pair), ordered)


def item_value(items: Column, key: str) -> Column:
    """Value of ``key``; null when the key is absent (a present empty value stays)."""
    hit = F.filter(items, lambda p: p["key"] == key)
    return F.get(F.transform(hit, lambda p: p["value"]), F.lit(0))


def item_values(items: Column) -> Column:
    return F.transform(items, lambda p: p["value"])

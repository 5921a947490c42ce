"""Parse rules as a table: which are active, and rows cut by the rule they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partsmith.functions.text import jtrim, let


def with_defaults(rules: DataFrame) -> DataFrame:
    """``(rule_id, rule_name, kv_sep, item_sep, escape, trim, ignore_empty, is_active, created_at)`` with the default of each null."""
    return rules.withColumns({
        "kv_sep": F.coalesce("kv_sep", F.lit(" ")), "item_sep": F.coalesce("item_sep", F.lit(";")),
        "escape": F.coalesce("escape", F.lit("")), "trim": F.coalesce("trim", F.lit(True)),
        "ignore_empty": F.coalesce("ignore_empty", F.lit(True)), "is_active": F.coalesce("is_active", F.lit(True))})


def active_rules(rules: DataFrame) -> DataFrame:
    """Rules that are switched on, the newest first when shown; a rule without the switch set is not among them."""
    return with_defaults(rules.where("is_active")).orderBy(F.col("created_at").desc(), "rule_id")


def rules_by_name(rules: DataFrame, keyword: str) -> DataFrame:
    return rules.where(F.contains("rule_name", F.lit(keyword)))


def parse_by(c: Column) -> Column:
    """Items of ``c`` by the rule columns of the same row; an empty escape or separator has no effect."""
    kv, item, escape = F.col("kv_sep"), F.col("item_sep"), F.col("escape")
    text = F.coalesce(c, F.lit(""))
    literal = F.concat(F.lit("\\Q"), item, F.lit("\\E"))
    cut = F.when(F.col("ignore_empty"), text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?:"), literal, F.lit(")+$")), F.lit("")))
    items = F.when(item == "", F.array(text)).otherwise(F.split(cut, literal, -1))
    items = F.transform(items, lambda x: F.when(F.col("trim"), jtrim(x)).otherwise(x))
    items = F.filter(items, lambda x: ~F.col("ignore_empty") | (x != ""))
    items = F.transform(items, lambda x: F.when(escape == "", x).otherwise(
        F.replace(F.replace(x, F.concat(escape, item), item), F.concat(escape, kv), kv)))

    def as_pair(x: Column) -> Column:
        at = F.when(kv == "", 0).otherwise(F.instr(x, kv))
        return F.struct(
            F.when(at > 0, jtrim(F.substring(x, F.lit(1), at - 1))).otherwise(F.lit("")).alias("key"),
            F.when(at > 0, jtrim(F.substring(x, at + F.length(kv), F.length(x)))).otherwise(jtrim(x)).alias("value"))

    def ordered(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        return F.transform(keys, lambda k, i: F.struct(
            i.cast("int").alias("pos"), k.alias("key"),
            F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))

    return let(F.transform(items, as_pair), ordered)


def parse_rows(rows: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """``rows(rule_id, ...)`` with ``items``; a row whose rule is missing or off is cut by the default rule."""
    columns = ("kv_sep", "item_sep", "escape", "trim", "ignore_empty")
    named = with_defaults(rules.where("is_active")).select("rule_id", *columns)
    filled = with_defaults(rows.join(named, "rule_id", "left").withColumns({
        "is_active": F.lit(True)}))
    return filled.withColumn("items", parse_by(F.col(text))).drop(*columns, "is_active")

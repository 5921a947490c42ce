"""Answering questions from the taxonomy and finding similar rows, for whole tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.config import DEFAULTS, Settings
from partsmith.functions import questions as Qn, text as T
from partsmith.operators import library as L, search as Q, taxonomy as X
from partsmith.operators.matcher import code_prefixes


def last_question(conversations: DataFrame) -> DataFrame:
    """The last non-empty user turn of each conversation."""
    return conversations.where((F.col("role") == "user") & (F.coalesce("text", F.lit("")) != "")).groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("question"))


def context(questions: DataFrame, taxonomy: DataFrame, idx: L.Indexes, cfg: Settings = DEFAULTS) -> DataFrame:
    """``(conv_id, category_id, pos)``: categories that bear on a question, by level and code.

    Codes, mentioned levels and keywords first; a listing question without a
    hit gets the top level, any other one a substring search.  The answer is cut
    to ``question_context_cap`` in (level, code) order, so every posting list
    may be cut to that many entries in the same order without losing one.
    """
    cap = cfg.question_context_cap
    nodes = taxonomy.select(F.col("id").alias("category_id"), "level", "category_code", "category_name")
    order = [F.col("level"), F.coalesce("category_code", F.lit("")), F.col("category_id")]
    asked = questions.where(~T.is_blank(F.col("question"))).withColumn("kw", Qn.without_codes(F.col("question")))

    codes = asked.select("conv_id", F.explode(Qn.codes_in(F.col("question"))).alias("code"))
    exact = L.by_code(codes, "code", idx, "hit")
    family = X.closure(taxonomy).select("root_id", "id")
    below = L.first_k(family.select(F.col("root_id").alias("hit"), F.col("id").alias("category_id")).join(nodes, "category_id"), "hit", order, cap)
    above = family.select(F.col("id").alias("hit"), F.col("root_id").alias("category_id"))
    kin = below.select("hit", "category_id").unionByName(above).distinct()
    by_code = exact.where("hit is not null").join(kin, "hit").select("conv_id", "category_id")
    heads = L.first_k(code_prefixes(taxonomy).select("prefix", F.col("node_id").alias("category_id")).join(nodes, "category_id"), "prefix", order, cap)
    by_prefix = exact.where("hit is null").join(heads, F.col("code") == F.col("prefix")).select("conv_id", "category_id")

    top = L.first_k(nodes, "level", order, cap).select("level", "category_id")
    by_level = asked.select("conv_id", F.explode(Qn.levels_in(F.col("question"))).alias("level")).join(top, "level").select("conv_id", "category_id")
    by_word = L.search(
        asked.select(F.col("conv_id").alias("question_id"), F.col("kw").alias("keyword")), taxonomy, idx, cfg.question_top_k
    ).select(F.col("question_id").alias("conv_id"), "category_id")
    found = by_code.unionByName(by_prefix).unionByName(by_level).unionByName(by_word).distinct()

    open_ = asked.join(found.select("conv_id").distinct(), "conv_id", "left_anti")
    first_level = top.where("level = 1").withColumn("listing", F.lit(True))
    listed = open_.withColumn("listing", Qn.is_listing(F.col("question"))).where("listing").join(first_level, "listing").select("conv_id", "category_id")
    rest = open_.where(~Qn.is_listing(F.col("question")) & ~T.is_blank(F.col("kw")))

    words = rest.select("conv_id", F.posexplode(T.tokens(F.col("kw"))).alias("place", "token")).where(F.length("token") >= 2)
    grams = nodes.select(
        "category_id", "category_code", "category_name",
        F.explode(F.array_union(T.bigrams(F.coalesce("category_name", F.lit(""))), T.bigrams(F.coalesce("category_code", F.lit(""))))).alias("gram"))
    keyed = words.select("token").distinct().withColumn("gram", F.substring("token", 1, 2))
    fits = F.contains("category_name", F.col("token")) | F.contains("category_code", F.col("token"))
    by_token = L.first_k(
        keyed.join(grams, "gram").where(fits).select("token", "category_id").distinct(), "token", [F.col("category_id")], cap)
    fuzzy = words.join(by_token, "token").groupBy("conv_id", "category_id").agg(F.min("place").alias("place"))
    fuzzy = L.first_k(fuzzy, "conv_id", [F.col("place"), F.col("category_id")], cap).select("conv_id", "category_id")

    w = Window.partitionBy("conv_id").orderBy(*order)
    everything = found.unionByName(listed).unionByName(fuzzy)
    return everything.join(nodes, "category_id").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select(
        "conv_id", "category_id", "pos")


def similar(questions: DataFrame, cleaned: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """``(conv_id, row_id, score, matched, place)``: rows that share most words with the asked item."""
    words = F.slice(T.tokens(Qn.similar_target(F.col("question"))), 1, cfg.similar_tokens)
    asked = questions.select(F.col("conv_id").alias("query_id"), words.alias("words")).where(F.size("words") > 0)
    recalled = Q.any_keyword(cleaned, asked, cfg.similar_recall, cfg.similar_tokens)
    hay = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("material_name", "specification", "full_description", "grade")])
    rows = cleaned.select("row_id", T.tokens(hay).alias("have"))
    hit = F.array_intersect(F.array_distinct("words"), F.col("have"))
    # a row's words are wider than the size of a file foretells: sorted, never broadcast
    scored = recalled.select("query_id", "row_id").join(rows.hint("merge"), "row_id").join(asked, "query_id").withColumn("hit", hit).where(F.size("hit") > 0)
    ratio = F.size("hit") / F.size(F.array_distinct("words"))
    ranked = scored.withColumn("score", F.floor(ratio * 100 + 0.5) / 100)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("row_id").desc())
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cfg.similar_top).select(
        F.col("query_id").alias("conv_id"), "row_id", "score", F.array_join("hit", "、").alias("matched"), "place")


def category_line(c: dict[str, Column]) -> Column:
    """One category as a line of text."""
    def part(label: str, value: Column) -> Column:
        return F.when(T.is_blank(value), F.lit("")).otherwise(F.concat(F.lit(label), value))

    desc = F.when(F.length(c["description"]) > 200, F.concat(F.substring(c["description"], 1, 200), F.lit("…"))).otherwise(c["description"])
    dash = F.lit("-")
    return F.concat(
        F.lit("[编码 "), F.coalesce(c["category_code"], dash), F.lit("] "), F.coalesce(c["category_name"], dash),
        F.lit("（层级"), F.coalesce(c["level"].cast("string"), dash), F.lit("） | 路径:"), F.coalesce(c["full_path"], dash),
        part(" | 单位:", c["unit"]), part(" | 说明:", desc))


def format_context(hits: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(conv_id, text)``: the lines of a question's categories, in order (at most the context cap)."""
    names = ("category_code", "category_name", "level", "full_path", "unit", "description")
    lines = taxonomy.select(F.col("id").alias("category_id"), category_line({n: F.col(n) for n in names}).alias("line"))
    return hits.join(lines, "category_id").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l")).select(
        "conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))

"""Standard library: indexes over the taxonomy, keyword search, recall and rule check."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.functions import text as T
from partsmith.operators.matcher import code_prefixes
from partsmith.session import stage

# Field weights of recall and points of the rule check.
CODE_WEIGHTS = {"category_code": 1.0, "material_code": 0.8}
TEXT_WEIGHTS = {
    "category_name": 0.9, "full_description": 0.95, "material_name": 0.85, "specification": 0.6, "grade": 0.5,
}
TOKEN_FACTOR = 0.6
#: texts of rows whose hits one task ranks
TEXTS_A_TASK = 20_000
NO_MATCH_REASON = "系统分类未命中标准库（无对应标准分类）"
NO_LIBRARY_REASON = "标准库未加载，使用中性评分"


@dataclass
class Indexes:
    code: DataFrame   # code_norm, category_id (one per code)
    name: DataFrame   # name_norm, category_id
    token: DataFrame  # token, category_id


def _slots(taxonomy: DataFrame, stem: str) -> list[str]:
    return sorted(c for c in taxonomy.columns if re.fullmatch(rf"old_{stem}_\d+", c))


def build_indexes(taxonomy: DataFrame, synonyms: DataFrame, tokenise_first: bool = False) -> Indexes:
    """Code, name and token lookups; the first category (by id, then slot) keeps a code."""
    codes = F.array("category_code", *_slots(taxonomy, "code"))
    code = (
        taxonomy.select("id", F.posexplode(F.transform(codes, T.norm_code)).alias("slot", "code_norm"))
        .where("code_norm is not null")
        .groupBy("code_norm").agg(F.min(F.struct("id", "slot")).alias("claim"))
        .select("code_norm", F.col("claim.id").alias("category_id"))
    )
    own = taxonomy.select(
        F.col("id").alias("category_id"), F.explode(F.array("category_name", *_slots(taxonomy, "name"))).alias("text"))
    alias = synonyms.join(
        taxonomy.select(F.col("id").alias("category_id")), "category_id", "left_semi"
    ).select("category_id", F.col("synonym_name").alias("text"))
    texts = own.unionByName(alias).withColumn("name_norm", T.norm_name(F.col("text"))).where("name_norm is not null")
    name = texts.select("name_norm", "category_id").distinct()
    token = texts.select(
        F.explode(T.name_tokens(F.col("text"), tokenise_first)).alias("token"), "category_id").distinct()
    return Indexes(code, name, token)


def by_code(df: DataFrame, code_col: str, idx: Indexes, out: str = "lib_id") -> DataFrame:
    """Add the id of the category that owns a current or old code."""
    keyed = df.withColumn("_code", T.norm_code(F.col(code_col)))
    return keyed.join(
        idx.code.select(F.col("code_norm").alias("_code"), F.col("category_id").alias(out)), "_code", "left"
    ).drop("_code")


def first_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key; Spark limits each map task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


# ---------------------------------------------------------------- recall

def _text_hits(tokens: DataFrame, names: DataFrame, idx: Indexes, codes: DataFrame, k: int) -> DataFrame:
    """Best ``k`` categories per distinct text as ``(text_key, category_id, factor)``.

    Keeping ``k`` per token, and then per text, cannot lose a final answer: all
    categories that stand before one in such a list score at least as high and
    win the tie, so an entry beyond place ``k`` never reaches a row's top ``k``.
    """
    posting = first_k(
        idx.token.join(codes, "category_id"), "token",
        [F.col("code").asc_nulls_last(), F.col("category_id")], k).drop("code")
    by_token = tokens.join(posting, "token").select("text_key", "category_id", F.lit(TOKEN_FACTOR).alias("factor"))
    by_name = names.join(
        idx.name.select(F.unhex(F.md5("name_norm")).alias("name_key"), "category_id"), "name_key").select(
        "text_key", "category_id", F.lit(1.0).alias("factor"))
    merged = by_token.unionByName(by_name).groupBy("text_key", "category_id").agg(F.max("factor").alias("factor"))
    return first_k(
        merged.join(codes, "category_id"), "text_key",
        [F.col("factor").desc(), F.col("code").asc_nulls_last(), F.col("category_id")], k
    ).select("text_key", "category_id", "factor")


def recall(rows: DataFrame, taxonomy: DataFrame, idx: Indexes, k: int = 10,
           code_weights: dict[str, float] = CODE_WEIGHTS, text_weights: dict[str, float] = TEXT_WEIGHTS,
           tokenise_first: bool = False) -> DataFrame:
    """``(row_id, category_id, category_code, relevance, rank)``: top ``k`` candidates per row.

    A category's relevance is the best of its hits; equal relevance is ordered
    by code.
    """
    codes = taxonomy.select(F.col("id").alias("category_id"), F.col("category_code").alias("code"))
    have = set(rows.columns)
    code_keys = F.array(*[
        F.struct(T.norm_code(F.col(c)).alias("code_norm"), F.lit(w).alias("weight"))
        for c, w in code_weights.items() if c in have])
    text_keys = F.array(*[
        F.struct(T.norm_name(F.col(c)).alias("norm"),
                 (F.col(c) if tokenise_first else F.lit(None).cast("string")).alias("text"),
                 F.lit(w).alias("weight"))
        for c, w in text_weights.items() if c in have])

    # a text is known by its digest from here on, so that long texts are never shuffled; normal forms and tokens are
    # made once and staged, because three columns of them are read apart
    key = F.md5(F.concat("norm", F.lit("\u0000"), F.coalesce("text", F.lit("")))) if tokenise_first else F.md5("norm")
    words = T.tokens(F.lower("text")) if tokenise_first else T.tokens(F.col("norm"))
    texts = stage(rows.select("row_id", F.inline(text_keys)).where("norm is not null").select(
        "row_id", F.unhex(key).alias("text_key"), F.unhex(F.md5("norm")).alias("name_key"), "weight",
        F.array_distinct(words).alias("tokens")), "recall-texts")
    weights = texts.select("row_id", "text_key", "weight")
    tokens = texts.select("text_key", F.explode("tokens").alias("token")).distinct()
    names = texts.select("text_key", "name_key").distinct()
    # What a text finds is one short list, and rows meet it sorted by text: the rows are never broadcast, however small their
    # files look. The lists are opened after rows have been dealt out by id, to as many tasks as their texts fill.
    found = _text_hits(tokens, names, idx, codes, k).groupBy("text_key").agg(
        F.collect_list(F.struct("category_id", "factor")).alias("found"))
    lists = weights.hint("merge").join(found, "text_key").select("row_id", "weight", "found")
    if any(c in have for c in code_weights):
        by_code_hits = rows.select("row_id", F.inline(code_keys)).where("code_norm is not null").join(
            idx.code, "code_norm").select("row_id", "weight", F.array(F.struct("category_id", F.lit(1.0).alias("factor"))).alias("found"))
        lists = lists.unionByName(by_code_hits)
    dealt = lists.repartition(1 + weights.count() // TEXTS_A_TASK, "row_id")
    hits = dealt.select("row_id", "weight", F.inline("found")).select(
        "row_id", "category_id", (F.col("weight") * F.col("factor")).alias("relevance"))

    best = hits.groupBy("row_id", "category_id").agg(F.max("relevance").alias("relevance")).join(codes, "category_id")
    w = Window.partitionBy("row_id").orderBy(
        F.col("relevance").desc(), F.col("code").asc_nulls_last(), F.col("category_id"))
    return (
        best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("row_id", "category_id", F.col("code").alias("category_code"), "relevance", "rank")
    )


# ---------------------------------------------------------------- keyword search

def keyword_union(questions: DataFrame, taxonomy: DataFrame, idx: Indexes, limit: int) -> DataFrame:
    """Hits of the four passes as ``(question_id, category_id, pass, place)``, each at its first place.

    Passes: exact code, code prefix, exact name, token by token.  Posting lists
    are cut to ``limit`` in answer order, which cannot lose one of the first
    ``limit`` answers.
    """
    q = questions.where(~T.is_blank(F.col("keyword"))).select(
        F.col("question_id"), T.jtrim(F.col("keyword")).alias("raw"), T.norm_name(F.col("keyword")).alias("norm"))
    exact = by_code(q, "raw", idx).where("lib_id is not null").select(
        "question_id", F.col("lib_id").alias("category_id"), F.lit(1).alias("pass"), F.lit(0).alias("place"))
    heads = first_k(code_prefixes(taxonomy), "prefix", [F.col("node_id")], limit)
    prefix = q.join(heads, F.col("raw") == F.col("prefix")).select(
        "question_id", F.col("node_id").alias("category_id"), F.lit(2).alias("pass"), F.lit(0).alias("place"))
    names = first_k(idx.name, "name_norm", [F.col("category_id")], limit)
    name = q.join(names, F.col("norm") == F.col("name_norm")).select(
        "question_id", "category_id", F.lit(3).alias("pass"), F.lit(0).alias("place"))
    words = first_k(idx.token, "token", [F.col("category_id")], limit)
    token = q.select("question_id", F.posexplode(T.tokens(F.col("norm"))).alias("place", "token")).join(
        words, "token").select("question_id", "category_id", F.lit(4).alias("pass"), "place")
    return (
        exact.unionByName(prefix).unionByName(name).unionByName(token)
        .groupBy("question_id", "category_id")
        .agg(F.min(F.struct("pass", "place")).alias("at"))
        .select("question_id", "category_id", "at.pass", "at.place")
    )


def search(questions: DataFrame, taxonomy: DataFrame, idx: Indexes, limit: int) -> DataFrame:
    """First ``limit`` categories per keyword: ``(question_id, category_id, pos)``."""
    w = Window.partitionBy("question_id").orderBy("pass", "place", "category_id")
    return (
        keyword_union(questions, taxonomy, idx, limit)
        .withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
        .select("question_id", "category_id", "pos")
    )


# ---------------------------------------------------------------- rule check

def name_agrees(category_name: Column, material_name: Column, std_name: Column, old_names: list[Column]) -> Column:
    given, material, std = T.norm_name(category_name), T.norm_name(material_name), T.norm_name(std_name)
    hit = F.coalesce(given == std, F.lit(False)) | T.contains_either(given, std, 2)
    for old in old_names:
        hit = hit | F.coalesce(given == T.norm_name(old), F.lit(False))
    hit = hit | F.coalesce(material == std, F.lit(False)) | T.contains_either(material, std, 2)
    return hit | F.coalesce(F.arrays_overlap(T.tokens(material), T.tokens(std)), F.lit(False))


def description_hit(description: Column, *fields: Column) -> Column:
    desc = T.norm_name(description)
    words = F.flatten(F.array(*[T.tokens(T.norm_name(f)) for f in fields]))
    return T.any_token_in(words, desc)


def rule_check(rows: DataFrame, taxonomy: DataFrame, idx: Indexes, matched: str = "category_id") -> DataFrame:
    """Add ``score, consistent, best_code, best_name, reason`` for the matched category.

    Reads ``category_code, category_name, material_name, specification, grade,
    unit`` and the id in ``matched``.
    """
    olds = _slots(taxonomy, "name")
    cat = taxonomy.select(
        F.col("id").alias("_id"), F.col("category_code").alias("_code"), F.col("category_name").alias("_name"),
        F.col("level").alias("_level"), F.col("unit").alias("_unit"), F.col("description").alias("_desc"),
        *[F.col(c).alias("_" + c) for c in olds])
    known = idx.code.select(F.col("code_norm").alias("_known"))
    joined = (
        rows.withColumn("_given", T.norm_code(F.col("category_code")))
        .join(cat, F.col(matched) == F.col("_id"), "left")
        .join(known, F.col("_given") == F.col("_known"), "left")
    )
    code_ok = F.col("_known").isNotNull()
    name_ok = name_agrees(F.col("category_name"), F.col("material_name"), F.col("_name"),
                          [F.col("_" + c) for c in olds])
    unit_ok = F.coalesce(T.same_unit(F.col("unit"), F.col("_unit")), F.lit(False))
    desc_ok = description_hit(F.col("_desc"), F.col("material_name"), F.col("specification"), F.col("grade"))
    level_points = F.when(F.col("_level") == 3, 15).when(F.col("_level") == 2, 8).when(F.col("_level").isNotNull(), 3).otherwise(0)
    total = (
        F.when(F.col("_c"), 35).otherwise(0) + F.when(F.col("_n"), 30).otherwise(0) + level_points
        + F.when(F.col("_u"), 10).otherwise(0) + F.when(F.col("_d"), 10).otherwise(0)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total.cast("double")))

    def word(flag: str, yes: str, no: str) -> Column:
        return F.when(F.col(flag), yes).otherwise(no)

    reason = F.concat(
        F.lit("编码"), word("_c", "一致", "不一致"), F.lit("，名称"), word("_n", "一致", "不一致"),
        F.lit("，层级"), F.coalesce(F.col("_level").cast("string"), F.lit("null")),
        F.lit("，单位"), word("_u", "一致", "不一致/空"),
        F.lit("，描述关键词"), word("_d", "命中", "未命中"))
    empty = taxonomy.limit(1).agg(F.count("*") == 0).scalar()
    missing = F.col("_id").isNull()
    flagged = joined.withColumns({"_c": code_ok, "_n": name_ok, "_u": unit_ok, "_d": desc_ok})
    return flagged.withColumns({
        "score": F.when(empty, 50.0).when(missing, 20.0).otherwise(score),
        "consistent": F.when(empty, F.col(matched).isNotNull()).when(missing, False).otherwise(F.col("_c") & F.col("_n")),
        "best_code": F.col("_code"),
        "best_name": F.col("_name"),
        "reason": F.when(empty, NO_LIBRARY_REASON).when(missing, NO_MATCH_REASON).otherwise(reason),
    }).select(*rows.columns, "score", "consistent", "best_code", "best_name", "reason")

"""Re-checking stored rows, classifying free text and applying corrections."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F

from partsmith.config import DEFAULTS, Settings
from partsmith.functions import scores as S, text as T
from partsmith.operators import library as L, scoring
from partsmith.operators.edits import last_edits

# Messages and weights of free-text classification.
NO_TEXT = "请输入待分类的物料描述文字"
NO_HIT = "标准库中未找到与输入相关的分类，请补充更明确的物料描述"
CORRECTION_REASON = "人工修正分类"


def detect(cleaned: DataFrame, taxonomy: DataFrame, idx: L.Indexes, k: int = DEFAULTS.recall_k) -> DataFrame:
    """Score, consistency, suggestion, reason and number of candidates per stored row.

    The category is looked up by the row's code.  A suggestion is shown only
    when it differs from the current category of an inconsistent row.
    """
    looked_up = L.by_code(cleaned, "category_code", idx, "_matched")
    checked = L.rule_check(looked_up, taxonomy, idx, "_matched")
    counts = L.recall(cleaned, taxonomy, idx, k).groupBy("row_id").agg(F.count("*").alias("candidate_count"))
    owner = idx.code.select(F.col("code_norm").alias("_b"), F.col("category_id").alias("_best_id"))
    best = checked.withColumn("_b", T.norm_code(F.col("best_code"))).join(owner, "_b", "left")
    hide = F.col("consistent") | F.coalesce(F.col("_best_id") == F.col("_matched"), F.lit(False))
    return best.join(counts, "row_id", "left").withColumns({
        "candidate_count": F.coalesce("candidate_count", F.lit(0)),
        "suggested_code": F.when(~hide, F.col("best_code")), "suggested_name": F.when(~hide, F.col("best_name")),
        "quality_score": F.col("score"), "accuracy_score": F.col("score") * 0.8,
    }).drop("_b", "_best_id", "_matched", "best_code", "best_name")


def check_file(details: DataFrame, cfg: Settings = DEFAULTS, adaptive: bool | None = None) -> DataFrame:
    """Thresholds over each file's scores, then a status for every checked row."""
    cfg = cfg if adaptive is None else replace(cfg, adaptive=adaptive)
    bounds = scoring.thresholds(details.select("title_id", "score"), "title_id", cfg)
    judged = details.drop("status").join(bounds, "title_id", "left")
    return judged.withColumn("status", S.status_of(F.col("score"), F.col("review"), F.col("export")))


def classify_text(texts: DataFrame, taxonomy: DataFrame, idx: L.Indexes, k: int = DEFAULTS.recall_k) -> DataFrame:
    """``texts(text_id, text)`` to the top recalled category, its relevance and a message."""
    # the text stands for description, name and specification alike, so only the largest of their weights can count
    fields = {"full_description": max(L.TEXT_WEIGHTS[f] for f in ("full_description", "material_name", "specification"))}
    rows = texts.where(~T.is_blank(F.col("text"))).select(
        F.col("text_id").alias("row_id"), *[F.col("text").alias(f) for f in fields])
    hits = L.recall(rows, taxonomy, idx, k, {}, fields)
    top = hits.groupBy("row_id").agg(
        F.count("*").alias("n_candidates"), F.min_by(F.struct("category_id", "relevance"), "rank").alias("best"))
    named = top.select(F.col("row_id").alias("text_id"), "n_candidates", "best.category_id", "best.relevance").join(
        taxonomy.select(F.col("id").alias("category_id"), F.col("category_code").alias("code"), F.col("category_name").alias("name")),
        "category_id", "left")
    message = (
        F.when(T.is_blank(F.col("text")), NO_TEXT).when(F.col("code").isNull(), NO_HIT)
        .otherwise(F.concat(
            F.lit("基于关键词匹配，从标准库召回 "), F.col("n_candidates").cast("string"),
            F.lit(" 个候选，推荐相关性最高的分类（相关性 "), F.col("relevance").cast("string"), F.lit("）"))))
    return texts.join(named, "text_id", "left").select(
        "text_id", "code", "name", "relevance", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), message.alias("message"))


@dataclass
class Correction:
    fixed: DataFrame
    cleaned: DataFrame
    summary: DataFrame


def apply_corrections(cleaned: DataFrame, corrections: DataFrame, taxonomy: DataFrame, idx: L.Indexes,
                      cfg: Settings = DEFAULTS) -> Correction:
    """Replace the category of ``corrections(row_id, target_code)``, rescore and give a status.

    ``cleaned`` may carry ``source_name``, the category name the row came with;
    it becomes the old name that feeds synonyms back.  A request without row or
    code is skipped, one with an unknown row or code fails.
    """
    asked = last_edits(corrections.where("target_code is not null"), ["row_id"])
    resolved = L.by_code(asked, "target_code", idx, "_target")
    target = taxonomy.select(
        F.col("id").alias("_target"), F.col("category_code").alias("_c"), F.col("category_name").alias("_n"),
        F.col("level").alias("_l"), F.col("full_path").alias("_p"))
    old_name = F.col("source_name") if "source_name" in cleaned.columns else F.col("category_name")
    changed = (
        cleaned.join(resolved.where("_target is not null").select("row_id", "_target"), "row_id").join(target, "_target")
        .withColumns({"old_name": old_name, "old_code": F.col("category_code")})
        .withColumns({"category_id": F.col("_target"), "category_code": F.col("_c"), "category_name": F.col("_n"),
                      "category_level": F.col("_l"), "category_full_path": F.col("_p")})
        .drop("_target", "_c", "_n", "_l", "_p"))
    fixed = L.rule_check(changed, taxonomy, idx).withColumns({
        "quality_score": F.col("score"), "accuracy_score": F.col("score") * 0.8,
        "status": S.status_of(F.col("score"), F.lit(cfg.review_threshold), F.lit(cfg.export_threshold))})
    fixed = fixed.drop("score", "consistent", "best_code", "best_name", "reason")
    base = [c for c in cleaned.columns]
    merged = cleaned.join(fixed.select("row_id"), "row_id", "left_anti").unionByName(fixed.select(*base))
    known = cleaned.select("row_id", F.lit(True).alias("_known"))
    tally = L.by_code(corrections, "target_code", idx, "_target").join(known, "row_id", "left")
    skip = F.col("row_id").isNull() | F.col("target_code").isNull()
    ok = F.col("_known").isNotNull() & F.col("_target").isNotNull()
    summary = tally.agg(
        F.count_if(~skip & ok).alias("applied"), F.count_if(skip).alias("skipped"), F.count_if(~skip & ~ok).alias("failed"))
    return Correction(fixed, merged, summary)


def feedback_synonyms(fixed: DataFrame, synonyms: DataFrame) -> DataFrame:
    """New ``(id, category_id, synonym_name, description)``: the old name now leads to the target.

    Ids follow the highest one known, since of several synonyms of a name the
    one of lowest id counts.  Numbers are dealt out per hash bucket with gaps
    between buckets, so no single task numbers them all.
    """
    name = T.jtrim(F.col("old_name"))
    wanted = fixed.where(~T.is_blank(F.col("old_name")) & (name != F.col("category_name"))).groupBy(
        "category_id", name.alias("synonym_name")).agg(
        F.min(F.concat(F.lit("分类修正自动回流("), F.coalesce("old_code", F.lit("")), F.lit("->"), "category_code", F.lit(")"))).alias("description"))
    fresh = wanted.join(synonyms.select("category_id", "synonym_name"), ["category_id", "synonym_name"], "left_anti")
    buckets = 256
    fresh = fresh.withColumn("_b", F.pmod(F.xxhash64("category_id", "synonym_name"), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("category_id", "synonym_name"))
    top = synonyms.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return fresh.withColumn("id", (top + (place - 1) * buckets + F.col("_b") + 1).cast("long")).select(
        "id", "category_id", "synonym_name", "description")


def correction_samples(fixed: DataFrame) -> DataFrame:
    return fixed.select(
        F.lit("CORRECTION").alias("sample_type"), F.col("row_id").alias("entity_id"),
        F.col("full_description").alias("source_text"), F.col("old_name").alias("source_category_name"),
        F.col("old_code").alias("source_category_code"), F.col("category_id").alias("target_category_id"),
        F.col("category_code").alias("target_category_code"), F.col("category_name").alias("target_category_name"),
        F.col("match_confidence").alias("confidence"), F.col("quality_score").alias("score"),
        F.lit(CORRECTION_REASON).alias("reason"), F.lit("pending").alias("status"))

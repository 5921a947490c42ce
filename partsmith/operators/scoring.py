"""Thresholds, statuses, duplicates and the rows they send to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.config import DEFAULTS, Settings
from partsmith.functions import scores as S

# Texts and defaults of generated tasks and samples.
LOW_SCORE_REASON = "质量评分过低: "
LOW_CONF_REASON = "AI 分类检测低置信/未匹配"


def percentiles(scores: DataFrame, key: str, ps: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles of ``score`` per ``key``, exact.

    Equal scores are counted first, so one group holds distinct scores only
    (rule scores have a few dozen values), however many rows share a file.
    """
    counts = scores.groupBy(key, "score").agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("score")
    total = F.sum("c").over(Window.partitionBy(key))
    upto = counts.withColumns({"upto": F.sum("c").over(w), "n": total})

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("score")))

    out = []
    for name, p in ps.items():
        place = (F.col("n") - 1) * F.lit(p)
        lo, hi = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append(F.when(part == 0, lo).otherwise(lo + part * (hi - lo)).alias(name))
    return upto.groupBy(key).agg(F.max("n").alias("n"), *out)


def thresholds(scores: DataFrame, key: str = "title_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """``(key, review, export)``: fixed, or drawn from the score distribution of the run."""
    if not cfg.adaptive:
        return scores.groupBy(key).agg(
            F.first(F.lit(cfg.review_threshold)).alias("review"), F.first(F.lit(cfg.export_threshold)).alias("export"))
    p = percentiles(scores, key, {"lo": cfg.review_percentile, "hi": cfg.export_percentile})

    def clamp(c: Column, bounds: tuple[float, float]) -> Column:
        return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), c))

    few = F.col("n") < cfg.adaptive_min_rows
    review, export = clamp(F.col("lo"), cfg.review_clamp), clamp(F.col("hi"), cfg.export_clamp)
    lifted = F.when(export <= review, F.least(F.lit(cfg.export_clamp[1]), review + 5)).otherwise(export)
    return p.select(
        key, F.when(few, cfg.review_threshold).otherwise(review).alias("review"),
        F.when(few, cfg.export_threshold).otherwise(lifted).alias("export"))


def with_status(rows: DataFrame, bounds: DataFrame | None = None, key: str = "title_id",
                cfg: Settings = DEFAULTS, score: str = "quality_score") -> DataFrame:
    """Add ``status``; with ``force_review`` an ambiguous or missing match always needs review."""
    if bounds is None:
        review, export = F.lit(cfg.review_threshold), F.lit(cfg.export_threshold)
    else:
        rows = rows.join(bounds, key, "left")
        review, export = F.col("review"), F.col("export")
    status = S.status_of(F.col(score), review, export)
    if cfg.force_review:
        doubtful = F.col("match_source").isin("FUZZY_AMBIGUOUS", "UNMATCHED") | F.col("category_id").isNull()
        status = F.when(doubtful, "needs_review").otherwise(status)
    return rows.withColumn("status", status)


def flag_duplicates(rows: DataFrame) -> DataFrame:
    """Add ``is_duplicate``: every row but the first with its fingerprint in a file.

    The first row of each fingerprint is a map-side minimum; the flag then
    joins on the unique row id, so copies of one record, however many, are
    never gathered in one place.
    """
    first = rows.groupBy("title_id", "source_row_hash").agg(
        F.min(F.struct("row_index", "row_id")).alias("at")).select(F.col("at.row_id").alias("row_id"), F.lit(0).alias("_f"))
    return rows.join(first, "row_id", "left").withColumn(
        "is_duplicate", F.when(F.col("_f").isNull(), 1).otherwise(0)).drop("_f")


def review_tasks(rows: DataFrame, review: Column) -> DataFrame:
    """One validation task per row scoring below the review threshold."""
    return rows.where(F.col("quality_score") < review).select(
        F.col("row_id").alias("entity_id"), "title_id",
        F.lit("data_validation").alias("task_type"), F.lit("medium").alias("priority"), F.lit("pending").alias("status"),
        F.concat(F.lit("数据验证: "), F.coalesce("material_name", F.lit(""))).alias("title"),
        F.concat(F.lit(LOW_SCORE_REASON), F.col("quality_score").cast("string")).alias("description"),
    )


def low_confidence(rows: DataFrame, samples: DataFrame | None, review: Column, doubtful: Column) -> DataFrame:
    """LOW_CONFIDENCE samples for doubtful rows below review, at most one per row ever."""
    new = rows.where((F.col("quality_score") < review) & doubtful).select(
        F.lit("LOW_CONFIDENCE").alias("sample_type"), F.col("row_id").alias("entity_id"),
        F.col("full_description").alias("source_text"), F.col("category_name").alias("source_category_name"),
        F.col("category_code").alias("source_category_code"), F.col("category_id").alias("target_category_id"),
        F.col("match_confidence").alias("confidence"), F.col("quality_score").alias("score"),
        F.lit(LOW_CONF_REASON).alias("reason"), F.lit("pending").alias("status"))
    if samples is None:
        return new
    known = samples.where("sample_type = 'LOW_CONFIDENCE'").select("entity_id")
    return new.join(known, "entity_id", "left_anti")

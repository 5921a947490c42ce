"""Cleaning runs over whole files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from partsmith.config import DEFAULTS, Settings
from partsmith.operators import cleaning, matcher, scoring
from partsmith.session import stage


@dataclass
class CleanRun:
    cleaned: DataFrame
    bounds: DataFrame
    tasks: DataFrame
    samples: DataFrame
    summary: DataFrame


def clean_batch(raw: DataFrame, header: DataFrame, taxonomy: DataFrame, synonyms: DataFrame,
                samples: DataFrame | None = None, cfg: Settings = DEFAULTS, model_scoring: bool = False,
                matching: matcher.CategoryMatcher = matcher.match) -> CleanRun:
    """Clean every file: rows, thresholds per file, statuses, review tasks, samples, counters.

    The scored rows are staged once because thresholds need the whole
    distribution before any status can be given.
    """
    scored = stage(cleaning.clean_rows(raw, header, taxonomy, synonyms, cfg, matching), "scored")
    bounds = scoring.thresholds(scored.select("title_id", F.col("quality_score").alias("score")), "title_id", cfg)
    judged = scoring.with_status(scored, bounds, "title_id", cfg)
    unmatched = F.col("match_source") == "UNMATCHED"
    low = scoring.low_confidence(judged, samples, F.col("review"), unmatched & F.lit(model_scoring))
    tasks = scoring.review_tasks(judged, F.col("review"))
    cleaned = judged.select(*cleaning.CLEANED_COLUMNS)
    summary = cleaned.groupBy("title_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("match_source") != "UNMATCHED").alias("matched"),
        F.count_if(F.col("match_source") == "UNMATCHED").alias("unmatched"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "export_ready").alias("export_ready"),
        F.sum("is_duplicate").alias("duplicates"),
    )
    return CleanRun(cleaned, bounds, tasks, low, summary)


def clean_one(raw: DataFrame, header: DataFrame, taxonomy: DataFrame, synonyms: DataFrame, row_ids: DataFrame,
              cfg: Settings = DEFAULTS) -> DataFrame:
    """Clean given rows again with fixed thresholds; the same job on a semi-joined input."""
    part = raw.join(row_ids, "row_id", "left_semi")
    scored = cleaning.clean_rows(part, header, taxonomy, synonyms, cfg)
    return scoring.with_status(scored, None, "title_id", cfg).select(*cleaning.CLEANED_COLUMNS)

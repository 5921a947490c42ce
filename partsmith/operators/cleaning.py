"""One cleaned row per raw row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partsmith.config import DEFAULTS, Settings
from partsmith.functions import scores as S
from partsmith.operators import ingest, library, matcher, scoring
from partsmith.session import stage

CORE = ("material_code", "material_name", "specification", "technical_standard", "grade", "unit")

CLEANED_COLUMNS = (
    "title_id", "row_id", "row_index", "category_id", "category_code", "category_level", "category_full_path",
    "category_name", "match_source", "match_confidence", *CORE, "full_description", "source_row_hash",
    "is_duplicate", "completeness_score", "quality_score", "accuracy_score", "status",
)


def fill_category(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Copy code, level, path and name of the matched category."""
    cat = taxonomy.select(
        F.col("id").alias("category_id"), "category_code", F.col("level").alias("category_level"),
        F.col("full_path").alias("category_full_path"), "category_name")
    return df.join(cat, "category_id", "left")


def fingerprint(cfg: Settings = DEFAULTS) -> Column:
    """Row hash over ``code|material code|spec|grade|description``.

    The cleaning run takes the hash before the core fields are filled, so
    those three places are empty; ``full_fingerprint`` hashes the filled row.
    """
    none = F.lit("")
    middle = [F.col(c) for c in ("material_code", "specification", "grade")] if cfg.full_fingerprint else [none] * 3
    return S.row_hash(F.col("category_code"), *middle, F.col("full_description"))


def clean_rows(raw: DataFrame, header: DataFrame, taxonomy: DataFrame, synonyms: DataFrame,
               cfg: Settings = DEFAULTS, matching: matcher.CategoryMatcher = matcher.match) -> DataFrame:
    """Parse, match, fill, fingerprint, flag, score.  Everything but the status.

    A row is parsed once: its core fields and what the matcher reads of it are
    staged together.
    """
    signals = ingest.signal_columns()
    read = stage(ingest.core_fields(ingest.parsed_rows(raw, header, cfg.rule)).select(
        "title_id", "row_id", "row_index", "full_description", *CORE, *[c.alias(name) for name, c in signals.items() if name not in CORE]), "read-rows")
    outcome = matching(read.select("row_id", *signals), taxonomy, synonyms).select(
        "row_id", "category_id", F.col("source").alias("match_source"), F.col("confidence").alias("match_confidence"))
    fields = read.select("title_id", "row_id", "row_index", "full_description", *CORE)
    filled = fill_category(fields.join(outcome, "row_id"), taxonomy)
    flagged = scoring.flag_duplicates(filled.withColumn("source_row_hash", fingerprint(cfg)))
    idx = library.build_indexes(taxonomy, synonyms)
    checked = library.rule_check(flagged, taxonomy, idx)
    return checked.withColumns({
        "completeness_score": S.completeness(*[F.col(c) for c in CORE]),
        "quality_score": F.col("score"),
        "accuracy_score": F.col("score") * 0.8,
    }).drop("score", "consistent", "best_code", "best_name", "reason")


def shard_key(cleaned: DataFrame, parts: int = 4) -> DataFrame:
    """Partition columns for output: id bucket and level-1 code of the match."""
    first = F.get(F.filter(F.split("category_full_path", "/"), lambda x: x != ""), F.lit(0))
    tree = F.when(F.col("category_id").isNull(), "UNMATCHED").otherwise(F.coalesce(first, F.lit("UNKNOWN")))
    return cleaned.withColumns({"hash_shard": F.pmod("row_id", F.lit(parts)), "tree_shard": tree})

"""Rows and review events that keep arriving."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from partsmith.config import DEFAULTS, Settings
from partsmith.operators import cleaning, review, scoring
from partsmith.session import release, stage, staged_so_far
from partsmith.streaming.tables import KeyedTable, each_batch


def clean(stream: DataFrame, header: DataFrame, taxonomy: DataFrame, synonyms: DataFrame, out: str,
          seen: KeyedTable, checkpoint: str, cfg: Settings = DEFAULTS) -> DataStreamWriter:
    """Clean newly arrived rows against the static taxonomy and append them to ``out``.

    Thresholds are fixed, since adaptive ones need the whole run.  ``seen``
    remembers fingerprints per file (an appended table keyed by both), so
    copies in later batches are flagged.
    """
    cfg = replace(cfg, adaptive=False)

    def step(batch: DataFrame, batch_id: int) -> None:
        mark = staged_so_far(batch.sparkSession)
        scored = stage(cleaning.clean_rows(batch, header, taxonomy, synonyms, cfg), "scored")
        keys = ["title_id", "source_row_hash"]
        known = seen.before(batch_id, scored)
        flagged = scored.join(known.withColumn("_seen", F.lit(True)), keys, "left").withColumn(
            "is_duplicate", F.when(F.col("_seen"), 1).otherwise(F.col("is_duplicate"))).drop("_seen")
        done = scoring.with_status(flagged, None, "title_id", cfg).select(*cleaning.CLEANED_COLUMNS)
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        fresh = batch.sparkSession.read.parquet(f"{out}/batch={batch_id}").select(*keys).distinct()
        seen.write(fresh.join(known, keys, "left_anti"), batch_id)
        release(batch.sparkSession, mark)

    return each_batch(stream, step, checkpoint)


def fold_reviews(stream: DataFrame, tasks: KeyedTable, checkpoint: str) -> DataStreamWriter:
    """Apply arriving review events to the task table, keyed by task; only the batch's tasks are read and written."""
    def step(batch: DataFrame, batch_id: int) -> None:
        mark = staged_so_far(batch.sparkSession)
        events = stage(batch, "review_batch")
        tasks.write(review.apply_events(tasks.before(batch_id, events), events)[0], batch_id)
        release(batch.sparkSession, mark)

    return each_batch(stream, step, checkpoint)

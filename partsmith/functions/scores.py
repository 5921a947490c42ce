"""Scores, statuses, fingerprints and small lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from partsmith.functions.text import is_blank

# Codes, labels and weights.
DATA_STATUS_TEXT = {
    "draft": "草稿", "processing": "清洗中", "needs_review": "待审核", "reviewing": "审核中",
    "approved": "审核通过", "rejected": "审核驳回", "modified": "已修改", "export_ready": "可导出",
    "processed": "已处理", "completed": "已完成",
}
TASK_STATUS_TEXT = {
    "pending": "待处理", "assigned": "已分配", "in_progress": "处理中", "completed": "已完成", "cancelled": "已取消",
}
PRIORITY_WEIGHT = {"low": 1, "medium": 3, "high": 5, "urgent": 10}
TASK_PROGRESS = {"completed": 100, "in_progress": 50, "assigned": 25}
EXPORTABLE = ("export_ready", "approved")
FORMAT_FACTOR = {"excel": 1.5, "json": 1.2, "pdf": 2.0}


def lookup(c: Column, table: dict) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, c)


def status_text(c: Column, labels: dict[str, str] = TASK_STATUS_TEXT) -> Column:
    """Label of a status code; an unknown code is shown as it is."""
    return F.coalesce(lookup(c, labels), c)


def priority_weight(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(c), PRIORITY_WEIGHT), F.lit(0))


def progress_of(c: Column) -> Column:
    return F.coalesce(lookup(c, TASK_PROGRESS), F.lit(0))


def round1(c: Column) -> Column:
    return F.floor(c * 10 + 0.5) / 10


def row_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def payload_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def completeness(*fields: Column) -> Column:
    """Share of filled fields, in percent."""
    filled = sum((F.when(is_blank(f), 0).otherwise(1) for f in fields), F.lit(0))
    return filled / F.lit(float(len(fields))) * 100


def status_of(score: Column, review: Column, export: Column) -> Column:
    return (
        F.when(score < review, "needs_review")
        .when(score >= export, "export_ready")
        .otherwise("approved")
    )


def deduction_score(row: dict[str, Column]) -> Column:
    """Optional older profile: start at 100 and deduct for missing fields."""
    # Points per missing field.
    points = {"material_code": 30, "material_name": 30, "technical_standard": 20, "grade": 10, "unit": 10}
    score = F.lit(100.0)
    for name, lost in points.items():
        score = score - F.when(is_blank(row[name]), lost).otherwise(0)
    score = score + F.when(row["category_id"].isNull(), -20).otherwise(10)
    score = score + F.when(row["completeness"] > 80, 10).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(score, F.lit(100.0)))


def field_valid(value: Column, required: Column, min_len: Column, max_len: Column, pattern: Column,
                allowed: Column | None = None) -> Column:
    """One value against one field rule; a missing value fails only when required.

    ``allowed`` is an optional JSON array of permitted values.
    """
    too_short = F.coalesce(F.length(value) < min_len, F.lit(False))
    too_long = F.coalesce(F.length(value) > max_len, F.lit(False))
    whole = F.concat(F.lit("^(?:"), F.nullif(pattern, F.lit("")), F.lit(")$"))
    off_pattern = F.coalesce(~F.regexp_like(value, whole), F.lit(False))
    bad = too_short | too_long | off_pattern
    if allowed is not None:
        permitted = F.from_json(allowed, "array<string>")
        bad = bad | F.coalesce((F.size(permitted) > 0) & ~F.array_contains(permitted, value), F.lit(False))
    return F.when(value.isNull(), ~F.coalesce(required, F.lit(False))).otherwise(~bad)


def hours_left(due: Column, now: Column) -> Column:
    return F.timestamp_diff("HOUR", now, due)


def overdue_days(due: Column, now: Column, done: Column) -> Column:
    late = due.isNotNull() & done.isNull() & (due < now)
    return F.when(late, F.timestamp_diff("DAY", due, now)).otherwise(F.lit(0).cast("long"))


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MINUTE", start, end)

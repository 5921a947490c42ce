"""Result rows that arrive from an external cleaning service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.functions import scores as S, text as T
from partsmith.operators.edits import ORDER
from partsmith.operators.order import page_of

# Payload schema, states and limits.
PAYLOAD = ("struct<taskId:string,status:string,error:string,"
           "stats:struct<total:bigint,high:bigint,medium:bigint,low:bigint,accuracy:double>,"
           "results:array<struct<index:int,categoryCode:string,categoryName:string,categoryPath:string,confidence:double,"
           "extractedAttrs:map<string,string>,missingAttrs:array<string>,needsReview:boolean,reviewReason:string>>>")
FINAL = ("completed", "failed", "cancelled")
DELETABLE = ("completed", "failed", "cancelled", "callback_timeout", "pending")
DECIDED = ("accepted", "corrected", "rejected")


def read_payloads(callbacks: DataFrame) -> DataFrame:
    """Add the digest, the parsed payload and the task it names."""
    return callbacks.withColumns({
        "digest": S.payload_digest(F.col("payload")), "body": F.from_json("payload", PAYLOAD),
    }).withColumn("task_id", F.col("body.taskId"))


def once(payloads: DataFrame) -> DataFrame:
    """The first arrival of every distinct payload (exact repeats are ignored)."""
    keyed = payloads.withColumn("digest", S.payload_digest(F.col("payload")))
    return keyed.groupBy("digest").agg(
        F.min("ts").alias("ts"), F.first("payload").alias("payload")
    ).withColumn("body", F.from_json("payload", PAYLOAD)).withColumn("task_id", F.col("body.taskId"))


def latest_stats(callbacks: DataFrame) -> DataFrame:
    """Statistics of each task's newest payload that carries any."""
    p = read_payloads(callbacks).where("body.stats is not null")
    last = p.groupBy("task_id").agg(F.max_by(F.col("body.stats"), "ts").alias("s"))
    return last.select("task_id", "s.total", "s.high", "s.low", "s.accuracy")


def result_items(payloads: DataFrame) -> DataFrame:
    """One row per result item that has an index."""
    items = payloads.select("task_id", "ts", F.posexplode("body.results").alias("place", "r")).where("r.index is not null")
    return items.select(
        "task_id", F.col("r.index").alias("row_index"), "ts", "place", F.col("r.categoryCode").alias("category_code"),
        F.col("r.categoryName").alias("category_name"), F.col("r.confidence").alias("confidence"),
        F.col("r.extractedAttrs").alias("attrs"), F.col("r.missingAttrs").alias("missing"),
        F.coalesce("r.needsReview", F.lit(False)).alias("needs_review"))


def upsert_rows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Newest item per (task, index) over stored rows; a human decision keeps its status."""
    keys = ["task_id", "row_index"]
    cols = ["category_code", "category_name", "confidence", "attrs", "missing", "needs_review"]
    newest = items.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("ts", "place")).alias("_n"))
    joined = rows.join(newest, keys, "full_outer")
    kept = F.col("row_status").isin(*DECIDED)
    return joined.withColumns({
        **{c: F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)) for c in cols},
        "row_status": F.when(F.col("_n").isNull() | F.coalesce(kept, F.lit(False)), F.col("row_status")).otherwise("completed"),
    }).select(*rows.columns)


def task_states(tasks: DataFrame, payloads: DataFrame) -> DataFrame:
    """Task status after all callbacks: the last payload decides, anything not final means processing."""
    said = F.when(F.col("body.status").isin(*FINAL), F.col("body.status")).otherwise("processing")
    last = payloads.groupBy("task_id").agg(
        F.max_by(F.struct(said.alias("status"), F.col("body.error").alias("error")), F.struct("ts", "digest")).alias("_l"),
        F.max("ts").alias("callback_at"))
    last = last.withColumnRenamed("callback_at", "_at")
    before = F.col("callback_at") if "callback_at" in tasks.columns else F.lit(None).cast("timestamp_ntz")
    return tasks.join(last, "task_id", "left").withColumns({
        "status": F.coalesce("_l.status", "status"), "callback_at": F.coalesce(F.col("_at"), before)}).drop("_l", "_at")


def callback_log(payloads: DataFrame, tasks: DataFrame) -> DataFrame:
    """One log row per processed payload: repeats and unknown tasks are not logged."""
    known = tasks.select("task_id")
    return payloads.join(known, "task_id", "left_semi").select(
        "task_id", "digest", "ts", F.when(F.col("body").isNull(), "error").otherwise("success").alias("result"))


def timed_out(tasks: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Processing tasks without a callback for ``minutes`` become callback_timeout."""
    overdue = (
        (F.col("status") == "processing") & F.col("callback_at").isNull() & F.col("submitted_at").isNotNull()
        & (F.col("submitted_at") <= now - F.expr(f"INTERVAL {minutes} MINUTES")))
    return tasks.withColumn("status", F.when(overdue, "callback_timeout").otherwise(F.col("status")))


def submit_rows(cells: DataFrame, existing: DataFrame, sync_rows: int, order: str = "row_index") -> DataFrame:
    """Snapshot rows of a task as ordered JSON with a continuous index.

    ``cells(task_id, row_id, row_index, snapshot)``; numbering continues after
    the rows ``existing`` already holds.  Numbers come from two steps: rank
    inside buckets of the order column, plus the size of the earlier buckets,
    so a task of any size is numbered in parallel.
    """
    bucket = F.floor(F.col(order) / 100000)
    keyed = cells.withColumn("_b", bucket)
    sizes = keyed.groupBy("task_id", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("task_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    held = existing.groupBy("task_id").agg((F.max("row_index") + 1).alias("_held"))
    totals = sizes.groupBy("task_id").agg(F.sum("_n").alias("_total"))
    within = Window.partitionBy("task_id", "_b").orderBy(order, "row_id")
    return (
        keyed.withColumn("_r", F.row_number().over(within) - 1)
        .join(offsets, ["task_id", "_b"]).join(held, "task_id", "left").join(totals, "task_id")
        .select("task_id", "row_id", (F.col("_r") + F.col("_off") + F.coalesce("_held", F.lit(0))).cast("long").alias("row_index"),
                "snapshot", F.lit("pending").alias("row_status"),
                F.when(F.col("_total") <= sync_rows, "sync").otherwise("async").alias("mode")))


def _sequence(edits: DataFrame, *fields: str) -> Column:
    """What orders the edits of a row: their ``seq``, and where that is missing or equal their values."""
    return F.struct(*([ORDER] if ORDER in edits.columns else []), *fields)


def decide(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply ``decisions(task_id, row_index, action, code, name, comment)`` one after the other, by ``seq`` if given.

    Actions are accept, reject and correct; a null ``row_index`` accepts every
    completed or pending row of the task.  The last decision on a row gives its
    status, the last correction that names a code (a name) gives that.
    """
    whole = decisions.where("row_index is null and action = 'accept'").select("task_id", F.lit(True).alias("_all")).distinct()
    order = _sequence(decisions, "action", "code", "name")
    corrects = F.col("action") == "correct"
    single = decisions.where("row_index is not null and action in ('accept', 'reject', 'correct')").groupBy("task_id", "row_index").agg(
        F.max_by("action", order).alias("action"),
        F.max_by("code", F.when(corrects & F.col("code").isNotNull(), order)).alias("_code"),
        F.max_by("name", F.when(corrects & F.col("name").isNotNull(), order)).alias("_name"))
    joined = rows.join(single, ["task_id", "row_index"], "left").join(whole, "task_id", "left")
    bulk = F.col("_all") & F.col("row_status").isin("completed", "pending")
    status = (
        F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected")
        .when(F.col("action") == "correct", "corrected").when(bulk, "accepted").otherwise(F.col("row_status")))
    return joined.withColumns({
        "row_status": status, "category_code": F.coalesce("_code", "category_code"), "category_name": F.coalesce("_name", "category_name"),
    }).select(*rows.columns)


def folded_fills(filled: DataFrame) -> DataFrame:
    """One ``given`` map per row: of several fills of a key the last one counts, by ``seq`` if given.

    Folded key by key, so the fills of a row are never gathered; blank for a
    null value.
    """
    order = _sequence(filled, "value")
    entries = filled.select("task_id", "row_index", *[c for c in filled.columns if c == ORDER], F.explode("given").alias("key", "value"))
    last = entries.groupBy("task_id", "row_index", "key").agg(F.max_by(F.coalesce("value", F.lit("")), order).alias("value"))
    return last.groupBy("task_id", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("given"))


def fill_missing(rows: DataFrame, filled: DataFrame) -> DataFrame:
    """Merge ``filled(task_id, row_index, given map)``, several per row in order; nothing missing any more clears the review flag."""
    joined = rows.join(folded_fills(filled), ["task_id", "row_index"], "left")
    none = F.create_map().cast("map<string,string>")
    old = F.transform_values(F.coalesce("attrs", none), lambda k, v: F.coalesce(v, F.lit("")))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("given", k)), F.col("given"))
    left = F.array_except(F.coalesce("missing", F.array().cast("array<string>")), F.map_keys("given"))
    asked = F.col("given").isNotNull()
    return joined.withColumns({
        "attrs": F.when(asked, merged).otherwise(F.col("attrs")),
        "missing": F.when(asked, F.when(F.size(left) > 0, left)).otherwise(F.col("missing")),
        "needs_review": F.when(asked & (F.size(left) == 0), False).otherwise(F.col("needs_review")),
    }).select(*rows.columns)


def retry(rows: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reset undecided rows of failed or timed-out tasks and count the retry."""
    again = F.col("status").isin("failed", "callback_timeout")
    chosen = tasks.where(again).select("task_id", F.lit(True).alias("_again"))
    reset = F.coalesce("_again", F.lit(False)) & ~F.col("row_status").isin("accepted", "corrected")
    new_rows = rows.join(chosen, "task_id", "left").withColumns({
        "row_status": F.when(reset, "pending").otherwise(F.col("row_status")),
        "category_code": F.when(reset, None).otherwise(F.col("category_code")),
        "attrs": F.when(reset, None).otherwise(F.col("attrs")),
        "needs_review": F.when(reset, False).otherwise(F.col("needs_review")),
    }).select(*rows.columns)
    new_tasks = tasks.withColumns({
        "retry_count": F.coalesce("retry_count", F.lit(0)) + F.when(again, 1).otherwise(0),
        "callback_at": F.when(again, None).otherwise(F.col("callback_at")),
        "status": F.when(again, "submitting").otherwise(F.col("status")),
    })
    return new_rows, new_tasks


def delete(tasks: DataFrame, rows: DataFrame, log: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop given tasks in a deletable state with their rows and log entries."""
    gone = tasks.join(ids, "task_id", "left_semi").where(F.col("status").isin(*DELETABLE)).select("task_id")
    return tuple(df.join(gone, "task_id", "left_anti") for df in (tasks, rows, log))


def attr_union(rows: DataFrame) -> DataFrame:
    """``(category_code, key, first_index)``: present and missing attribute keys per category."""
    none = F.array().cast("array<string>")
    keys = F.array_union(F.coalesce(F.map_keys("attrs"), none), F.coalesce("missing", none))
    return rows.select("category_code", "task_id", "row_index", F.explode(keys).alias("key")).groupBy("category_code", "key").agg(
        F.min(F.struct("task_id", "row_index")).alias("at")).select(
        "category_code", "key", F.col("at.task_id").alias("first_task"), F.col("at.row_index").alias("first_index"))


# The group of rows without a category, and what stands before raw column names.
NO_CATEGORY, RAW_PREFIX = "未分类", "原始-"


def rows_by_category(rows: DataFrame, std_header: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Long export ``(task_id, category, row_index, pos, key, value)``, one sheet per task and category.

    A category is its name, else its code, else 未分类.  First come the raw
    columns that its rows have, as 原始-name in file order, from
    ``raw(task_id, row_index, pos, name, value)`` or, for a row without any,
    from its ``snapshot``; then all columns of its standard header (that of the
    code of its first row), then other attributes as first seen.  What a row
    lacks is blank.
    """
    none = F.array().cast("array<string>")
    keyed = rows.withColumn("category", F.when(~T.is_blank(F.col("category_name")), F.col("category_name")).when(
        ~T.is_blank(F.col("category_code")), F.col("category_code")).otherwise(F.lit(NO_CATEGORY)))
    sheet = ["task_id", "category"]

    keys = F.array_union(F.coalesce(F.map_keys("attrs"), none), F.coalesce("missing", none))
    seen = keyed.select(*sheet, "row_index", F.posexplode(keys).alias("i", "key")).groupBy(*sheet, "key").agg(
        F.min(F.struct("row_index", "i")).alias("first"))
    code = keyed.groupBy(*sheet).agg(F.min_by("category_code", "row_index").alias("category_code"))
    standard = code.join(std_header.select("category_code", F.col("target").alias("key"), F.col("pos").alias("std")), "category_code").where(
        "key is not null").groupBy(*sheet, "key").agg(F.min("std").alias("std"))
    columns = standard.join(seen, [*sheet, "key"], "full").select(
        *sheet, "key", F.lit(1).alias("part"), F.struct(F.col("std").isNull().alias("extra"), "std", "first").alias("at"))
    cells = keyed.select(*sheet, "row_index", F.lit(1).alias("part"), F.explode("attrs").alias("key", "value"))

    if "snapshot" in rows.columns:
        stored = keyed.select("task_id", "row_index", F.posexplode(F.from_json("snapshot", "map<string,string>")).alias("pos", "name", "value"))
        if raw is not None:
            own = raw.select("task_id", "row_index").distinct()
            raw = raw.select("task_id", "row_index", "pos", "name", "value").unionByName(stored.join(own, ["task_id", "row_index"], "left_anti"))
        else:
            raw = stored
    if raw is not None:
        place = raw.groupBy("task_id", "name").agg(F.min("pos").alias("pos"))
        named = keyed.select(*sheet, "row_index").join(raw.select("task_id", "row_index", "name", "value"), ["task_id", "row_index"])
        raw_columns = named.select(*sheet, "name").distinct().join(place, ["task_id", "name"]).select(
            *sheet, F.concat(F.lit(RAW_PREFIX), "name").alias("key"), F.lit(0).alias("part"),
            F.struct(F.lit(False).alias("extra"), F.col("pos").cast("int").alias("std"),
                     F.struct(F.lit(0).cast("long").alias("row_index"), F.lit(0).alias("i")).alias("first")).alias("at"))
        columns = columns.select(*sheet, "key", "part", F.struct("at.extra", F.col("at.std").cast("int").alias("std"), F.struct(
            F.col("at.first.row_index").cast("long").alias("row_index"), "at.first.i").alias("first")).alias("at")).unionByName(raw_columns)
        cells = cells.unionByName(named.select(
            *sheet, "row_index", F.lit(0).alias("part"), F.concat(F.lit(RAW_PREFIX), "name").alias("key"), "value"))

    w = Window.partitionBy(*sheet).orderBy("part", "at.extra", "at.std", "at.first.row_index", "at.first.i", "key")
    numbered = columns.withColumn("pos", F.row_number().over(w)).drop("at")
    return keyed.select(*sheet, "row_index").join(numbered, sheet).join(
        cells, [*sheet, "row_index", "part", "key"], "left").select(
        "task_id", "category", "row_index", "pos", "key", F.coalesce("value", F.lit("")).alias("value"))


def write_by_category(sheets: DataFrame, path: str) -> None:
    """One folder per task and category, its files by name and their rows in order.

    Cells are cut in ranges of about equal size between rows: a large sheet
    becomes several files, small ones are written by one task.
    """
    sheets.repartitionByRange("task_id", "category", "row_index").sortWithinPartitions("task_id", "category", "row_index", "pos").write.partitionBy(
        "task_id", "category").parquet(path)


# Sort fields of the task list.
TASK_SORT = {"fileName": "file_name", "submittedAt": "submitted_at", "completedAt": "completed_at", "status": "status",
             "estimatedAccuracy": "estimated_accuracy"}


def list_tasks(tasks: DataFrame, number: int, size: int, status: str | None = None, sort: str | None = None, order: str | None = None) -> DataFrame:
    """One page of external tasks, of one status if asked for; unknown sort fields mean the creation time, descending unless ``asc``."""
    out = tasks.where(F.col("status") == status) if status and status.strip() else tasks
    key = TASK_SORT.get(sort or "", "created_at")
    return page_of(out, [(key, (order or "").lower() != "asc"), ("task_id", False)], (max(number, 1) - 1) * size, size)


def page_of_rows(rows: DataFrame, task_id: str, number: int, size: int, doubtful: bool = False) -> DataFrame:
    """One page of a task's rows by place, of those under review only if asked for."""
    out = rows.where(F.col("task_id") == task_id)
    out = out.where("needs_review") if doubtful else out
    return page_of(out, [("row_index", False)], (max(number, 1) - 1) * size, size)

"""External results as a stream: idempotent merge, log, progress, timeouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from partsmith.operators import external as X
from partsmith.session import release, stage, staged_so_far
from partsmith.streaming.tables import KeyedTable, each_batch


def ingest(stream: DataFrame, rows: KeyedTable, tasks: KeyedTable, log: KeyedTable, checkpoint: str) -> DataStreamWriter:
    """Merge callbacks into rows, tasks and log, batch by batch.

    A payload counts once ever: repeats inside the batch collapse on the digest,
    earlier ones are known from the log.  A late callback still applies.
    ``rows`` is keyed by task and index, ``tasks`` by task, ``log`` by digest
    and appended to; only what the batch names is read, only what it changes
    is written.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        mark = staged_so_far(batch.sparkSession)
        arrived = stage(X.once(batch).select("digest", "ts", "payload"), "arrived")
        told = X.read_payloads(arrived).select("task_id").where("task_id is not null")
        known = tasks.before(batch_id, told)
        seen = log.before(batch_id, arrived)
        fresh = X.read_payloads(arrived.join(seen.select("digest"), "digest", "left_anti")).join(
            known.select("task_id"), "task_id", "left_semi")
        items = X.result_items(fresh)
        rows.write(X.upsert_rows(rows.before(batch_id, items), items), batch_id)
        tasks.write(X.task_states(known, fresh), batch_id)
        log.write(X.callback_log(fresh, known), batch_id)
        release(batch.sparkSession, mark)

    return each_batch(stream, merge, checkpoint)


def arrivals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """One row per distinct payload: ``(task_id, digest, ts, result_rows, failed, total)``, for an append sink.

    A repeat within ``late`` of the first arrival is dropped; what has to be
    remembered for that goes with the watermark.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return X.read_payloads(timed).dropDuplicatesWithinWatermark(["digest"]).select(
        "task_id", "digest", "ts", F.coalesce(F.size("body.results"), F.lit(0)).alias("result_rows"),
        F.coalesce(F.col("body.status") == "failed", F.lit(False)).alias("failed"), F.col("body.stats.total").alias("total"))


def progress(arrived: DataFrame) -> DataFrame:
    """Counts per task of what :func:`arrivals` has written: callbacks, result rows, failures."""
    return arrived.groupBy("task_id").agg(
        F.count("*").alias("callbacks"), F.sum("result_rows").alias("result_rows"),
        F.count_if("failed").alias("errors"), F.max("total").alias("total"))


STATUS = "task_id string, status string, last_at timestamp, digest string"


def last_status(stream: DataFrame, table: KeyedTable, checkpoint: str) -> DataStreamWriter:
    """Newest status per task, in a table keyed by task with the columns of :data:`STATUS`.

    A batch is reduced to one row per task and settled against the stored row
    of that task, so callbacks count however late they come, repeats change
    nothing, and the stream itself keeps no state, whatever the number of
    tasks: a task that falls silent costs only its row.
    """
    order = F.struct("last_at", "digest")

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("task_id").agg(F.max_by(F.struct("status", "last_at", "digest"), order).alias("n")).select("task_id", "n.*")

    def merge(batch: DataFrame, batch_id: int) -> None:
        mark = staged_so_far(batch.sparkSession)
        told = X.read_payloads(batch).where("task_id is not null").select(
            "task_id", F.col("body.status").alias("status"), F.col("ts").cast("timestamp").alias("last_at"), "digest")
        arrived = stage(newest(told), "statuses")
        held = table.before(batch_id, arrived)
        same = held.select("task_id", "last_at", "digest")
        table.write(newest(held.unionByName(arrived)).join(same, ["task_id", "last_at", "digest"], "left_anti"), batch_id)
        release(batch.sparkSession, mark)

    return each_batch(stream, merge, checkpoint)


TIMEOUT_OUT = "task_id string, status string"
# What a batch leaves behind of a task whose time is not up: times in milliseconds.
_WAITING = "task_id string, submitted long, heard boolean, until long"


def watch_timeouts(stream: DataFrame, out: str, state: str, checkpoint: str, minutes: int = 30, late: str = "10 minutes") -> DataStreamWriter:
    """``(task_id, status)`` into ``out``: a submitted task that hears nothing for ``minutes`` times out.

    ``stream(task_id, ts, kind)`` mixes ``submit`` and ``callback`` events; the
    timer runs on event time (the newest so far, less ``late``) and is cancelled
    by a callback.  The first callback of a task is reported once; that it came
    is remembered for ``minutes`` after it, so a submit that arrives in a later
    batch starts no timer.  Rows older than the mark a batch starts with are
    dropped.

    A batch is one aggregate over its rows and the tasks still waiting, which
    are all that ``state`` holds, in a folder per batch; a batch that failed
    writes the same folders again.
    """
    wait_ms = minutes * 60 * 1000

    def watch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        begun = staged_so_far(spark)
        ms, called = F.unix_millis(F.col("ts").cast("timestamp")), F.coalesce(F.col("kind") == "callback", F.lit(False))
        rows, mark = batch.select("task_id", ms.alias("ms"), called.alias("called")), None
        waiting = spark.createDataFrame([], _WAITING)
        if batch_id > 0:
            mark = spark.read.schema("mark long").parquet(f"{state}/{batch_id - 1}/mark").first()["mark"]
            waiting = spark.read.schema(_WAITING).parquet(f"{state}/{batch_id - 1}/tasks")
        if mark is not None:
            rows = rows.where(F.col("ms") > mark)
        told = rows.select("task_id", F.when(~F.col("called"), F.col("ms")).alias("submitted"), F.col("called").alias("heard"),
                           F.lit(False).alias("known"), (F.col("ms") + wait_ms).alias("until"))
        held = waiting.select("task_id", "submitted", "heard", F.col("heard").alias("known"), "until")
        tasks = stage(told.unionByName(held).groupBy("task_id").agg(
            F.min("submitted").alias("submitted"), F.bool_or("heard").alias("heard"), F.bool_or("known").alias("known"), F.max("until").alias("last")
        ).withColumn("until", F.when(F.col("heard"), F.col("last")).otherwise(F.col("submitted") + wait_ms)), "watched")
        newest = F.unix_millis(F.timestamp_millis(F.max("last") - wait_ms) - F.expr(f"INTERVAL {late}"))
        mark = tasks.agg(F.greatest(F.lit(mark).cast("long"), newest).alias("mark")).first()["mark"]

        due = F.col("until") < F.lit(mark).cast("long")
        status = F.when(F.col("heard") & ~F.col("known"), "callback_received").when(~F.col("heard") & due, "callback_timeout")
        tasks.select("task_id", status.alias("status")).where("status is not null").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        tasks.where(~due).select("task_id", "submitted", "heard", "until").write.mode("overwrite").parquet(f"{state}/{batch_id}/tasks")
        spark.createDataFrame([(mark,)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{state}/{batch_id}/mark")
        past = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{batch_id - 2}")  # the last batch's is read again if this one has to be
        past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)
        release(spark, begun)

    return each_batch(stream, watch, checkpoint)

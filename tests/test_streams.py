"""Tables and states of streams while they grow."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from partsmith.streaming import callbacks as C
from partsmith.streaming import tables as T

SCHEMA = "k long, part string, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(table):
    return {(r.k, r.part): r.v for r in table.latest().collect()}


def written(root, batch):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{root}/v={batch}") for f in files if f.endswith(".parquet"))


def manifest(root, batch):
    with open(f"{root}/manifests/{batch}.json") as f:
        return json.load(f)


def test_table_equals_a_dict_while_buckets_split(spark, tmp_path):
    rng = random.Random(5)
    root = str(tmp_path / "t")
    first = {(i, "a"): "start" for i in range(40)}
    table = T.KeyedTable(spark, root, frame(spark, [(*k, v) for k, v in first.items()]), ["k", "part"], bucket_bytes=6_000)
    want = dict(first)
    for batch in range(14):
        new = {(rng.randrange(200), rng.choice("ab")): f"{batch}-{rng.random()}" * 3 for _ in range(25)}
        rows = frame(spark, [(*k, v) for k, v in new.items()])
        before = {(r.k, r.part): r.v for r in table.before(batch, rows).collect()}
        assert before == {k: v for k, v in want.items() if k in new}
        if batch == 6:  # a batch that failed after its write and is run again with other rows
            table.write(frame(spark, [(1, "a", "lost"), (999, "z", "lost")]), batch)
        table.write(rows, batch)
        want.update(new)
        if batch % 4 == 1:
            assert state(table) == want
    assert state(table) == want
    last = manifest(root, 13)
    assert len(last["buckets"]) > 2  # split from one
    depths = [int(name.split("-")[0]) for name in last["buckets"]]
    assert sum(2.0 ** -d for d in depths) == 1  # buckets tile the hash space
    again = T.KeyedTable(spark, root, frame(spark, []), ["k", "part"], bucket_bytes=6_000)  # a restart keeps what is there
    assert state(again) == want


def test_bytes_of_a_batch_do_not_grow_with_the_table(spark, tmp_path):
    """A table a hundred times the batch, then of four hundred batches' size: the rows written per batch stay the same."""
    per_batch = {}
    for rows in (200, 20_000):
        root = str(tmp_path / f"n{rows}")
        start = spark.range(rows).select(F.col("id").alias("k"), F.lit("p").alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        table = T.KeyedTable(spark, root, start, ["k", "part"], bucket_bytes=200_000)
        sizes = []
        for batch in range(4):
            table.write(frame(spark, [(rows + batch * 50 + i, "p", f"{batch}{i}") for i in range(50)]), batch)
            sizes.append(spark.read.parquet(f"{root}/v={batch}").count())
        per_batch[rows] = sizes
        assert sum(1 for n in os.listdir(f"{root}/manifests") if n.endswith(".json") and not n.startswith(".")) <= 3
    assert per_batch[20_000] == per_batch[200] == [50] * 4


def test_a_row_is_rewritten_once_for_each_doubling(spark, tmp_path):
    root = str(tmp_path / "log")
    table = T.KeyedTable(spark, root, frame(spark, []), ["k", "part"], append=True, bucket_bytes=1 << 20)
    for batch in range(24):
        table.write(frame(spark, [(batch * 20 + i, "p", "x") for i in range(20)]), batch)
    assert table.latest().count() == 480
    runs = manifest(root, 23)["buckets"]["0-0"]
    assert len(runs) <= 8  # not one for each batch
    assert not os.path.exists(f"{root}/v=0/_bucket=0-0")  # merged and gone


def test_keys_of_a_hot_task_are_spread(spark, tmp_path):
    """A task that holds nearly all rows is split, since its rows are keyed by their index too."""
    rows = spark.range(6000).select(F.lit(1).cast("long").alias("k"), F.col("id").cast("string").alias("part"), F.lit("v").alias("v"))
    table = T.KeyedTable(spark, str(tmp_path / "hot"), rows, ["k", "part"], bucket_bytes=20_000)
    sizes = [sum(s for _, s in runs) for runs in manifest(str(tmp_path / "hot"), -1)["buckets"].values()]
    assert len(sizes) > 1 and max(sizes) < 2 * min(sizes)
    assert table.latest().count() == 6000


@pytest.fixture
def calls(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "ts timestamp_ntz, payload string"

    def add(*rows):
        data = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), json.dumps({"taskId": t, "status": s, "n": m})) for m, t, s in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)

    return folder, schema, add


def test_silent_tasks_leave_no_state_and_late_callbacks_count(spark, tmp_path, calls):
    folder, schema, add = calls
    add((0, "T1", "processing"), (1, "T2", "processing"))
    table = T.KeyedTable(spark, str(tmp_path / "status"), spark.createDataFrame([], C.STATUS), ["task_id"])

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        query = C.last_status(stream, table, str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == []

    run()
    add((200, "T3", "processing"))
    run()
    add((3, "T1", "completed"), (0, "T2", "failed"), (200, "T3", "processing"))  # one newer than what is stored, one older, one repeat
    run()
    got = {r.task_id: r.status for r in table.latest().collect()}
    assert got == {"T1": "completed", "T2": "processing", "T3": "processing"}
    assert spark.read.parquet(str(tmp_path / "status" / "v=2")).count() == 1  # only what changed is written

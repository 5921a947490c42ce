"""Tables in the shared folder that ``foreachBatch`` merges write to."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

BUCKET, VERSION = "_bucket", "_version"
#: a bucket beyond so many bytes is split; runs of like size are merged from so many on
BUCKET_BYTES = 128 << 20
MERGE_RUNS = 4


class KeyedTable:
    """A table of rows with a unique, never null ``key``, whose cost per micro-batch follows the batch.

    A batch writes one run of rows per bucket that it touches, holding only
    the rows it made or changed; the newest row of a key counts.  ``append``
    says that a key is written once, so that nothing has to be compared.
    Runs of like size in a bucket are merged, so a row is rewritten once for
    each doubling of its bucket.  A bucket holds the keys whose hash ends in
    its bits, and a bucket beyond ``bucket_bytes`` is split by further bits,
    as in extendible hashing.

    ``manifests/<batch>.json`` names every bucket's runs after a batch (some
    hundred bytes a bucket), so a batch reads one manifest and the runs of the
    buckets it needs, and lists only the folder it wrote.  A batch that is run
    again starts from the manifest before it and overwrites its own folder,
    whatever happened to executors or the driver.  Runs that a merge replaced
    go one batch later.
    """

    def __init__(self, spark: SparkSession, root: str, initial: DataFrame, key: list[str], append: bool = False,
                 bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.schema, self.key = spark, root, initial.schema, key
        self.append, self.bucket_bytes = append, bucket_bytes
        if self._newest() is None:
            self._start(initial)

    # -- files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _remove(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def _sizes(self, folder: str) -> dict[str, int]:
        """Bytes per bucket of one version."""
        path, fs = self._path(folder)
        found: dict[str, int] = {}
        files = fs.listFiles(path, True)
        while files.hasNext():
            file = files.next()
            name = file.getPath().getParent().getName()
            if name.startswith(f"{BUCKET}="):
                name = name[len(BUCKET) + 1:]
                found[name] = found.get(name, 0) + file.getLen()
        return found

    def _load(self, batch_id: int) -> dict[str, Any] | None:
        path, fs = self._path(f"manifests/{batch_id}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, manifest: dict[str, Any]) -> None:
        name = f"manifests/{manifest['batch']}.json"
        path, fs = self._path(name)
        draft, _ = self._path(f"{name}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs.delete(path, False)
        fs.rename(draft, path)

    def _newest(self, before: int | None = None) -> int | None:
        """Number of the newest manifest, or of the newest before a batch."""
        path, fs = self._path("manifests")
        if not fs.exists(path):
            return None
        names = (s.getPath().getName() for s in fs.listStatus(path))
        known = [int(n[:-5]) for n in names if n.endswith(".json")]
        return max((n for n in known if before is None or n < before), default=None)

    def _manifest(self, before: int | None) -> dict[str, Any]:
        """What the table held before a batch (the end of all batches, if None)."""
        found = self._load(before - 1) if before is not None else None
        return found if found is not None else self._load(self._newest(before))

    # -- buckets

    @staticmethod
    def _name(depth: int, bits: int) -> str:
        return f"{depth}-{bits}"

    def _placed(self, rows: DataFrame, buckets: dict[str, Any]) -> DataFrame:
        """``rows`` with their bucket, looked up by the last bits of the hash of their key."""
        places = [tuple(map(int, name.split("-"))) for name in buckets]
        deepest = max(depth for depth, _ in places)
        if deepest == 0:
            return rows.withColumn(BUCKET, F.lit(self._name(0, 0)))
        slots = [(bits | more << depth, self._name(depth, bits)) for depth, bits in places for more in range(1 << deepest - depth)]
        directory = self.spark.createDataFrame(slots, f"_slot long, {BUCKET} string")
        hashed = rows.withColumn("_slot", F.xxhash64(*self.key).bitwiseAND(F.lit((1 << deepest) - 1).cast("long")))
        return hashed.join(directory, "_slot").drop("_slot")

    def _read(self, folders: list[str]) -> DataFrame:
        kept = self.schema.fieldNames()
        if not folders:
            return self.spark.createDataFrame([], self.schema).withColumn(VERSION, F.lit(0).cast("long"))
        stored = self.spark.createDataFrame([], self.schema).withColumn(VERSION, F.lit(0).cast("long")).schema
        return self.spark.read.schema(stored).parquet(*[f"{self.root}/{f}" for f in folders]).select(*kept, VERSION)

    def _newest_rows(self, rows: DataFrame) -> DataFrame:
        """One row per key, the one of the highest version, with that version."""
        if self.append:
            return rows
        rest = [c for c in rows.columns if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), VERSION).alias("_last"))
        return last.select(*self.key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*rows.columns)

    def _start(self, initial: DataFrame) -> None:
        """The rows to begin with, in as many buckets as their size asks for."""
        name = "v=start"
        initial.write.mode("overwrite").parquet(f"{self.root}/{name}")
        path, fs = self._path(name)
        size, depth = fs.getContentSummary(path).getLength(), 0
        while size >> depth > self.bucket_bytes // 2:
            depth += 1
        buckets = {self._name(depth, bits): [] for bits in range(1 << depth)}
        self._commit(self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}").withColumn(VERSION, F.lit(-1).cast("long")),
                     {"batch": -1, "buckets": buckets, "dropped": [name]})

    def _commit(self, rows: DataFrame, manifest: dict[str, Any]) -> None:
        """Write runs into the buckets of ``manifest``, add them to it and save it."""
        folder = f"v={manifest['batch']}"
        self._placed(rows, manifest["buckets"]).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        for name, size in self._sizes(folder).items():
            manifest["buckets"][name].append([f"{folder}/{BUCKET}={name}", size])
        self._save(manifest)

    def _to_merge(self, runs: list) -> int:
        """The run from which on a bucket's runs are to be merged (their number: none)."""
        if sum(size for _, size in runs) > self.bucket_bytes:
            return 0
        at, total = len(runs), 0
        while at and (at == len(runs) or runs[at - 1][1] <= 2 * total):
            at -= 1
            total += runs[at][1]
        return at if len(runs) - at >= MERGE_RUNS else len(runs)

    # -- what merges use

    def before(self, batch_id: int, keys: DataFrame | None = None) -> DataFrame:
        """Rows as they were before a batch, only those with a key in ``keys`` if given."""
        buckets = self._manifest(batch_id)["buckets"]
        if keys is not None:
            keys = keys.select(*self.key).distinct()
            touched = [r[0] for r in self._placed(keys, buckets).select(BUCKET).distinct().collect()]
            buckets = {name: buckets[name] for name in touched}
        rows = self._read([folder for runs in buckets.values() for folder, _ in runs])
        if keys is not None:
            rows = rows.join(keys, self.key, "left_semi")
        several = any(len(runs) > 1 for runs in buckets.values())
        return (self._newest_rows(rows) if several else rows).drop(VERSION)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows that a batch made or changed; rows of other keys stay."""
        manifest = self._manifest(batch_id)
        for folder in manifest["dropped"]:
            self._remove(folder)
        buckets, dropped, merged = {}, [], []
        for name, runs in manifest["buckets"].items():
            at = self._to_merge(runs)
            dropped += [folder for folder, _ in runs[at:]]
            depth, bits = map(int, name.split("-"))
            size, more = sum(size for _, size in runs), 0
            while size >> more > self.bucket_bytes:
                more += 1
            for upper in range(1 << more):  # a bucket that is split has no runs left, all are merged anew
                buckets[self._name(depth + more, bits | upper << depth)] = list(runs[:at])
            merged += [folder for folder, _ in runs[at:]]
        rows = rows.select(*self.schema.fieldNames()).withColumn(VERSION, F.lit(batch_id).cast("long"))
        if merged:
            old = self._read(merged)
            old = old if self.append else self._newest_rows(old).join(rows.select(*self.key), self.key, "left_anti")
            rows = rows.unionByName(old)
        self._commit(rows, {"batch": batch_id, "buckets": buckets, "dropped": dropped})
        if batch_id > 0:
            path, fs = self._path(f"manifests/{batch_id - 2}.json")
            fs.delete(path, False)

    def latest(self) -> DataFrame:
        """All rows after the last batch."""
        runs = [folder for runs in self._manifest(None)["buckets"].values() for folder, _ in runs]
        return self._newest_rows(self._read(runs)).drop(VERSION)


def run_available(writer: DataStreamWriter) -> None:
    """Work through everything that has arrived and stop."""
    query: StreamingQuery = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def each_batch(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)

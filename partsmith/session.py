"""Session helpers: a local builder for tests and the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE does the size-checked work: it turns a shuffle join into a broadcast join
# only after measuring the shuffled side, splits hot join partitions and
# coalesces small ones.  Nothing in this package carries a broadcast hint on
# data that grows with the input.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "partsmith", cores: str = "8", shuffle_partitions: int = 8,
                  memory: str = "16g") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_OWN: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """Folder every executor can reach: ``folder``, else the one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder serves only in local mode, where driver and
    executors are the same process (``local-cluster`` is not).
    """
    if folder is not None:
        return folder.rstrip("/")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        known = spark.sparkContext.getCheckpointDir()
        if known is not None:
            named = os.path.dirname(known.rstrip("/"))
    if named is None:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors, or hand one over")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="partsmith-")
        named = _OWN[context.applicationId]
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A path in the shared folder that nothing uses yet; :func:`release` removes what is written there."""
    path = f"{shared_dir(spark, folder)}/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the staged folders of this application from the ``since``-th on, once nothing reads them any more."""
    for path in _STAGED.get(spark.sparkContext.applicationId, [])[since:]:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove one folder that :func:`new_path` named."""
    paths = _STAGED[spark.sparkContext.applicationId]
    paths.remove(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged_so_far(spark: SparkSession) -> int:
    return len(_STAGED.get(spark.sparkContext.applicationId, []))


def stage(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage with data that outlives any executor, and unlike a
    checkpoint the Parquet copy still allows column pruning and pushdown.
    """
    spark = df.sparkSession
    path = new_path(spark, label, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

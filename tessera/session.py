"""Session settings, table loading and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the library is tested under; on a cluster bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        # workers unpickle functions of this package by name; on a cluster ship it with --py-files
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(filter(None, [str(Path(__file__).parent.parent), os.environ.get("PYTHONPATH")])))
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work per row that costs far more than reading it.

    Rows stay where the scan's splits put them. A caller whose table is one row group, which is one task whatever the
    number of cores, may set `tessera.deal` to a number of partitions to deal it out to; it moves the table once.
    Arrow batches are bounded by bytes, as Python's memory would follow the texts in them.
    """
    small_batches(spark)
    df, parts = table(spark, sf_dir, name), int(spark.conf.get("tessera.deal", "0"))
    return df.repartition(parts) if parts else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, as a full URI.

    Only a session whose executors are this machine's own process gets a folder of ours where the setting is missing.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "tessera-shared")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets Arrow batches end at so many bytes, so that a Python worker's memory doesn't follow the length of texts.

    Spark's default is 64 MB, which a task holds several times; a smaller setting of the session is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(key, "64m")))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_sweep)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path  # for `release`
    return out


def made(df: DataFrame | None = None) -> set[str]:
    """Paths of the tables made by `materialize` that are still there: all, or that of a frame as it was returned."""
    return set(_made) if df is None else {getattr(df, "_tessera_path", "")} & set(_made)


def release_all(paths: set[str]) -> None:
    for path in paths & set(_made):
        _delete(_made.pop(path), path)


def release(*frames: DataFrame) -> None:
    """Delete tables made by `materialize`, once nothing reads them any more."""
    for df in frames:
        release_all(made(df))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203 - the JVM may be gone at exit; the next session's table may not
            continue


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """A broadcast hint only when the counted size allows it; beyond it Spark joins with a shuffle."""
    return F.broadcast(df) if rows <= limit else df

"""Streams over the events table: an extension, since everything else here reads tables that don't change.

Each function maps a streaming (or static) DataFrame; `drain` runs one to its end into a table of the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir


def source(spark: SparkSession, sf_dir: str, name: str = "events", files_per_batch: int = 1) -> DataFrame:
    """Files as they appear; the time column becomes a plain timestamp for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote last: appended rows, or the state of its last batch."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex[:12]}"
    last = {"path": None}

    def write(batch: DataFrame, n: int) -> None:
        path = f"{root}/out" if mode == "append" else f"{root}/out-{n}"
        batch.write.mode("overwrite" if mode != "append" else "append").parquet(path)
        last["path"] = path

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(last["path"]) if last["path"] else spark.createDataFrame([], df.schema)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_text(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """First arrival of each normalised text within the watermark."""
    return docs.withColumn("h", F.sha2(F.lower("text"), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["h"])


def with_users(events: DataFrame, users: DataFrame) -> DataFrame:
    return events.join(users, "user_id", "left")


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total so far, by state kept for each user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, total = state.get if state.exists else (0, 0.0)
        for df in batches:
            n += len(df)
            total += float(df["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 2)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def run(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    return drain(f(source(spark, sf_dir)), mode)

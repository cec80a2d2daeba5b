"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

Every stable key goes to one of `shards` shards; no table of the ring exists, and when shards are appended only the
fraction that the new shards must hold moves, always to a new shard. The key is the value's text, of whatever type,
hashed to 60 bits by MD5, so a shard depends on nothing but key and number of shards.

Defined cases: a null key has a null shard; equal keys, repeated rows among them, share a shard; an empty text is a key
like any other; an empty table gives an empty result; a column that is already called as the result is replaced.
The work is a projection: no shuffle, one Arrow-vectorised function for the loop that SQL functions lack.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 1024
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    key, out = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    j, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(live):
        out[live] = j
        key = key * _STEP + np.uint64(1)
        j = np.floor((j + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        stay = j < shards
        key, j, live = key[stay], j[stay], live[stay]
    return out


def key_of(column: Column) -> Column:
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 15), 16, 10).cast("long")


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, out: str = "shard") -> DataFrame:
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    known = df[key].isNotNull()
    return df.withColumn(out, F.when(known, place(F.coalesce(key_of(df[key]), F.lit(0)))))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """One folder a shard; one shuffle brings a shard's rows together."""
    shard(df, key, shards).repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(source: str = "documents", shards: int = SHARDS) -> str:
    return f"""
WITH RECURSIVE hop(k, h, b, j) AS (
  SELECT DISTINCT doc_id, CAST(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 15) AS BIGINT) AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT)
  FROM {source} WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT k, (h * 2862933555777941757 + 1) % 18446744073709551616, j,
         CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(((h * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
  FROM hop WHERE j < {shards})
SELECT d.*, CAST(hop.b AS INTEGER) AS shard FROM {source} d LEFT JOIN hop ON d.doc_id = hop.k AND hop.j >= {shards}"""


QUERIES = {"op1_jump_shards": query}
SQL = {"op1_jump_shards": sql()}

"""Documents and tables as stored artefacts: Parquet for tables of nodes, JSON for single artefacts under a size cap."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAP = 16 << 20


def unique_name(title: str | None) -> str:
    base = re.sub(r"[^A-Za-z0-9._-]+", "-", title or "").strip("-.")[:60] or "document"
    return f"{base}-{uuid.uuid4().hex[:8]}"


def store(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_artifact(df: DataFrame, name: str) -> str:
    """A small table as one JSON text with its schema; too large a one is refused, not cut, and before any row is brought here."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("j")), F.lit(0))).first()[0]
    if size > CAP:
        raise ValueError(f"artefact of over {size} bytes; at most {CAP}")
    body = {"mime": "application/vnd.tessera.table+json", "name": name, "schema": json.loads(df.schema.json()), "rows": [json.loads(r[0]) for r in rows.toLocalIterator()]}
    text = json.dumps(body, ensure_ascii=False)
    if len(text.encode()) > CAP:
        raise ValueError(f"artefact of {len(text.encode())} bytes; at most {CAP}")
    return text


def from_artifact(spark: SparkSession, text: str) -> DataFrame:
    from pyspark.sql.types import StructType

    body = json.loads(text)
    if body.get("mime") != "application/vnd.tessera.table+json":
        raise ValueError("not a stored table")
    schema = StructType.fromJson(body["schema"])
    lines = spark.createDataFrame([(json.dumps(r),) for r in body["rows"]], "j string")
    return lines.select(F.from_json("j", schema).alias("r")).select("r.*")

"""Plain text: paragraphs are what blank lines divide. Column expressions all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sep: str = "\n\n") -> DataFrame:
    """Block rows (doc_id, body_index, node_type, heading_depth, text, page, attrs, kv)."""
    parts = F.filter(F.transform(F.split(F.col(text_col), sep, -1), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    empty = F.create_map().cast("map<string,string>")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(parts).alias("body_index", "text")).select(
        "doc_id", "body_index", F.lit("paragraph").alias("node_type"), F.lit(None).cast("int").alias("heading_depth"), "text", F.lit(None).cast("int").alias("page"), empty.alias("attrs"), empty.alias("kv")
    )

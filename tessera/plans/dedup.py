"""Queries on duplicate texts: the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dedup import text_hash
from tessera.session import texts

QUERIES, SQL = {}, {}


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose normalised texts are equal (compatibility forms, case, white space), with their survivor."""
    docs = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    return text_hash(docs).select("cluster_id", "canonical", "member", "member_ord")


QUERIES["dedup_text_hash"] = duplicate_texts
SQL["dedup_text_hash"] = r"""
WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) h FROM documents WHERE trim(text) <> ''),
g AS (SELECT h, min(doc_id) canonical FROM k GROUP BY h HAVING count(*) > 1)
SELECT 'text_' || left(h, 16) AS cluster_id, canonical, doc_id AS member, CAST(row_number() OVER (PARTITION BY h ORDER BY doc_id) - 1 AS INTEGER) AS member_ord FROM k JOIN g USING (h)"""

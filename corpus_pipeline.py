"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a DataFrame; all but the
last return the columns of `documents`. Columns beside doc_id, text and source pass through, whatever they are called.

Defined cases, for every stage: an empty table gives an empty result; texts of any length are read whole; a null doc_id,
lang, source or n_chars is kept unless the stage's rule is about the text; what each does with null and empty texts,
ties and repeated rows is in its docstring. `run` deletes each stage's tables once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from tessera.session import made, materialize, release_all


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated probability of at least one half go.

    Null and empty texts are scored like any other; equal texts have equal scores, so repeated rows go or stay together; without
    labels the score is 0 and all stay.
    """
    return toxicity.reject_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id (null last); of repeated rows one stays.

    Texts without a word have no copies and stay. Rows that share an id but not the text are documents of their own.
    """
    return jaccard_join.one_of_each_group(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go, exact or edited; null and empty texts hold none; repeated rows go or stay together."""
    return decontaminate.reject_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The fair-queueing mix, up to its budget of tokens.

    A null source is one of its own; null and empty texts have 0 tokens and stay where their turn comes before the end; ties
    of id go by tokens and text, and equal rows stay or go together.
    """
    return mixing.select_documents(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `shard`, by the id; a null id has a null shard; a column of that name is replaced."""
    return sharding.shard(docs)


STAGES = [("toxicity", _toxicity), ("near_duplicates", _near), ("decontamination", _benchmark), ("mixing", _mix), ("sharding", _shard)]
#: Trees and alignment have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = made()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
            release_all(made() - before - made(docs))  # what the stage kept for itself
            if i:
                release_all(last)
            last = made(docs)
    return docs

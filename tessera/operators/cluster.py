"""Cluster labels by class-based TF-IDF, with diversification and exemplars."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ngrams, tokens


def class_tfidf(
    texts: DataFrame, min_df: int = 1, sqrt_tf: bool = False, bm25_idf: bool = False, ngram_range: tuple[int, int] = (1, 2), stopwords: frozenset[str] | None = None, token_prefix: int = 0
) -> DataFrame:
    """cluster_id, term, score from (ord, cluster_id, text): tf in the class over its terms, times ln(1 + A / f), A the mean terms a class.

    Terms are n-grams of the lower-cased tokens that are left without the caller's stopwords, cut to `token_prefix` letters if
    that isn't 0. min_df is on a term's occurrences in all classes.
    """
    ts = tokens(F.col("text"))
    if stopwords:
        stop = sorted(stopwords)
        ts = F.filter(ts, lambda t: ~t.isin(stop))
    if token_prefix:
        ts = F.transform(ts, lambda t: F.substring(t, 1, token_prefix))
    kept = texts.select("cluster_id", ts.alias("ts"))
    lo, hi = ngram_range
    t = kept.select("cluster_id", F.explode(F.concat(*[ngrams(F.col("ts"), n) for n in range(lo, hi + 1)])).alias("term"))
    tf = t.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.sum("tf").alias("f")).where(F.col("f") >= min_df)
    size = tf.groupBy("cluster_id").agg(F.sum("tf").alias("size"))
    mean = size.agg(F.avg("size").alias("A"))
    share = F.col("tf") / F.col("size")
    share = F.sqrt(share) if sqrt_tf else share
    idf = F.log(1 + (F.col("A") - F.col("f") + 0.5) / (F.col("f") + 0.5)) if bm25_idf else F.log(1 + F.col("A") / F.col("f"))
    return tf.join(df, "term").join(size, "cluster_id").crossJoin(mean).select("cluster_id", "term", (share * idf).alias("score"))


def trigrams(terms: list[str]) -> np.ndarray:
    """Character trigrams as vectors, for callers without an embedder of their own."""
    grams = [{w[i : i + 3] for i in range(max(1, len(w) - 2))} for w in terms]
    known = {g: i for i, g in enumerate(sorted(set().union(*grams)))}
    out = np.zeros((len(terms), len(known)))
    for r, g in enumerate(grams):
        out[r, [known[x] for x in g]] = 1
    return out


def select_diverse(vectors: np.ndarray, score: np.ndarray, k: int, diversity: float) -> list[int]:
    """Maximal marginal relevance: relevance scaled to 0..1 against the largest cosine with what is chosen, lambda = 1 - diversity."""
    if len(score) <= k:
        return list(range(len(score)))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm == 0, 1, norm)
    low, top = score.min(), score.max()
    rel = (score - low) / (top - low) if top > low else np.ones(len(score))
    chosen, near = [], np.zeros(len(score))
    while len(chosen) < k:
        value = np.round((1 - diversity) * rel - diversity * near, 12)
        value[chosen] = -np.inf
        i = int(np.argmax(value))
        chosen.append(i)
        sim = unit @ unit[i]
        near = sim if len(chosen) == 1 else np.maximum(near, sim)
    return chosen


def label_clusters(texts: DataFrame, k: int = 10, diversity: float = 0.0, embedder: Callable[[list[str]], np.ndarray] = trigrams, **how: object) -> DataFrame:
    """cluster_id, rank, term, score. diversity > 0: maximal marginal relevance over a pool of max(3 k, 30) terms by the embedder's vectors."""
    scored = class_tfidf(texts, **how)
    pool = k if diversity <= 0 else max(3 * k, 30)
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("score", 12)), "term"))).where(F.col("rank") <= pool)
    if diversity <= 0:
        return best.select("cluster_id", "rank", "term", "score")

    def pick(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rank")
        out = df.iloc[select_diverse(np.asarray(embedder(df["term"].tolist()), float), df["score"].to_numpy(), k, diversity)].copy()
        out["rank"] = range(1, len(out) + 1)
        return out[["cluster_id", "rank", "term", "score"]]

    return best.groupBy("cluster_id").applyInPandas(pick, "cluster_id long, rank int, term string, score double")


def exemplars(texts: DataFrame) -> DataFrame:
    """The longest text of each cluster (the earliest of equals), and the cluster's size."""
    best = F.max(F.struct(F.length("text").alias("n"), (-F.col("ord")).alias("neg"))).alias("b")
    return texts.groupBy("cluster_id").agg(best, F.count(F.lit(1)).alias("size")).select("cluster_id", "size", (-F.col("b.neg")).alias("exemplar"))

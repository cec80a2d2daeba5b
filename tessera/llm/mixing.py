"""Mixing sources to target weights by weighted fair queueing.

Inside each source the documents stand in a random but fixed order (a hash of the id). A document's virtual finish time
is the number of tokens of its source up to and including it, divided by the source's target weight. All documents
together are sorted by that time and the mix ends where the running total of tokens would pass the budget: every
prefix of the mix follows the weights as long as a source lasts.

Prefix sums are distributed. The hash order of a source is cut into `BUCKETS` equal ranges of the hash; the sums of
(source, range) are a small table that is summed up by a window, and inside a range another window adds the rest, so
a source that holds most of the corpus is spread over all tasks. The global order is a range partitioning of narrow
rows (id, source, tokens, time), written once to the shared folder; partition totals give each partition its offset.
Texts are read once, for the narrow rows (id, source, tokens) that all sums and orders are made of, and never move.

Defined cases: a null source is a source of its own, apart from '' (both have the weight of '' in `weights`); a source
that the weights lack has weight `default`; weight 0 keeps a source out, its tokens count for the budget; null and empty
texts have 0 tokens and are kept where their turn comes before the end; a text of any length is counted whole; rows with
equal ids follow by tokens and then by text, equal rows are interchangeable; an empty table gives an empty mix; other
columns are never read. Tokens are runs of characters that aren't white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import broadcast_if_small, materialize

#: Target weights of a production mix; sources that are not named have weight 1.
WEIGHTS = {"src0": 6.0, "src1": 4.0, "src2": 3.0, "src3": 2.0, "src4": 2.0, "src5": 0.5}
#: Share of the corpus's tokens that the mix holds at most.
SHARE = 0.6
BUCKETS = 4096
SEED = "mix"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    w = F.lit(float(default))
    for k, v in weights.items():
        w = F.when(source == k, F.lit(float(v))).otherwise(w)
    return w


def place_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def digest_of(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def narrow(docs: DataFrame, weights: dict[str, float], default: float) -> DataFrame:
    """id, source, tokens, place in the source's order, digest of the text for equal ids, and weight."""
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        n_tokens(docs["text"]).alias("tokens"),
        place_of(docs["doc_id"]).alias("place"),
        digest_of(docs["text"]).alias("digest"),
        _weight(F.coalesce(docs["source"], F.lit("")), weights, default).alias("weight"),
    )


def finish_times(rows: DataFrame) -> DataFrame:
    """rows: as of `narrow`."""
    # a null source and '' have the same `s` but not the same `none`
    s, none = F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")
    rows = rows.where("weight > 0").select("*", s, none, F.shiftright("place", 60 - (BUCKETS.bit_length() - 1)).alias("range"))
    key = ["s", "none", "range"]
    sums = rows.groupBy(*key).agg(F.sum("tokens").alias("t"))
    before = sums.select(*key, (F.sum("t").over(Window.partitionBy("s", "none").orderBy("range")) - F.col("t")).alias("before"))
    inside = Window.partitionBy(*key).orderBy("place", F.col("doc_id").asc_nulls_first(), "tokens", "digest").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(before, key)
        .withColumn("used", F.col("before") + F.sum("tokens").over(inside))
        .withColumn("finish", F.col("used").cast("double") / F.col("weight"))
        .select("doc_id", "source", "tokens", "place", "digest", "finish")
    )


def mix(docs: DataFrame, budget: int | None = None, share: float = SHARE, weights: dict[str, float] = WEIGHTS, default: float = 1.0) -> DataFrame:
    """doc_id, source, tokens, finish, total (tokens up to here, in the order of the mix) for the documents that the mix holds."""
    order = [F.col("finish"), F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("tokens"), F.col("digest")]
    rows = materialize(narrow(docs, weights, default), "tokens")
    part = materialize(finish_times(rows).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix")
    sums = part.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = sums.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    if budget is None:
        # all tokens, those of sources with weight 0 too
        limit = rows.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(share))).alias("budget"))
    else:
        limit = docs.sparkSession.range(1).select(F.lit(int(budget)).cast("long").alias("budget"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        part.join(before, "part")
        .crossJoin(limit)
        .withColumn("total", F.col("before") + F.sum("tokens").over(inside))
        .where("total <= budget")
        .select("doc_id", "source", "tokens", "finish", "total", "place", "digest")
    )


def select_documents(docs: DataFrame, **how: object) -> DataFrame:
    """The documents that the mix holds, all columns, without moving a text.

    The mix holds a prefix of each source's order, so the last place in each source says it all. A place is a 60-bit
    hash of the id; only rows that share the last one are compared by id, tokens and text as in the mix.
    """
    lowest = F.lit(-(1 << 63))
    last = mix(docs, **how).groupBy(F.col("source").alias("__s")).agg(F.max(F.struct("place", F.coalesce("doc_id", lowest).alias("d"), "tokens", "digest")).alias("__last"))
    last = materialize(last, "last")  # a row a source; counted, so that the hint is given to a small table only
    last = broadcast_if_small(last, last.count())
    place, end = place_of(docs["doc_id"]), last["__last"]
    here = F.struct(F.coalesce(docs["doc_id"], lowest).alias("d"), n_tokens(docs["text"]).alias("tokens"), digest_of(docs["text"]).alias("digest"))
    upto = (place < end["place"]) | ((place == end["place"]) & (here <= F.struct(end["d"].alias("d"), end["tokens"].alias("tokens"), end["digest"].alias("digest"))))
    return docs.join(last, docs["source"].eqNullSafe(last["__s"]) & upto).select(*[docs[f"`{c}`"] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("place", "digest")


def sql(source: str = "documents", share: float = SHARE, columns: str = "doc_id, source, tokens, finish, total") -> str:
    weight = "CASE coalesce(source, '') " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in WEIGHTS.items()) + " ELSE CAST(1 AS DOUBLE) END"
    return f"""
WITH t AS (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) tokens,
                  CAST('0x' || left(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT) place, {weight} w FROM {source}),
f AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY place, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS DOUBLE) / w AS finish FROM t WHERE w > 0),
g AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY finish, place, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM f)
SELECT {columns} FROM g WHERE total <= (SELECT floor(CAST(sum(tokens) AS DOUBLE) * {share}) FROM t)"""


QUERIES = {"op3_fair_mix": query}
SQL = {"op3_fair_mix": sql()}

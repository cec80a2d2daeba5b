"""Tables with logical column types: inference, profiles, validation, pivot of extracted cells, slices.

A logical type that storage doesn't tell apart (MONEY, SCORE, VERBATIM_QUOTE, ...) is kept in the column's metadata
under `logical`, so nothing is lost on the way through Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize

LOGICAL = {
    "TEXT": T.StringType(), "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(),
    "TIME": T.LongType(), "DATETIME": T.TimestampNTZType(), "NULL": T.StringType(), "DECIMAL": T.DecimalType(38, 10), "BINARY": T.BinaryType(),
    "DURATION": T.DayTimeIntervalType(), "LIST": T.ArrayType(T.StringType()), "STRUCT": T.StringType(), "VERBATIM_QUOTE": T.StringType(),
    "MONEY": T.StructType([T.StructField("amount", T.DecimalType(38, 10)), T.StructField("currency", T.StringType())]), "SCORE": T.IntegerType(),
    "ENTITY_ROLE": T.StructType([T.StructField("name", T.StringType()), T.StructField("role", T.StringType()), T.StructField("entity_type", T.StringType())]),
}
COMPARABLE = ("INTEGER", "FLOAT", "DECIMAL", "DATE", "DATETIME", "TIME", "TEXT")


def logical_type(field: T.StructField) -> str:
    if "logical" in (field.metadata or {}):
        return field.metadata["logical"]
    d = field.dataType
    for kinds, name in (((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "INTEGER"), ((T.FloatType, T.DoubleType), "FLOAT"), ((T.DecimalType,), "DECIMAL"), ((T.BooleanType,), "BOOLEAN"), ((T.DateType,), "DATE"), ((T.TimestampType, T.TimestampNTZType), "DATETIME"), ((T.BinaryType,), "BINARY"), ((T.DayTimeIntervalType,), "DURATION"), ((T.ArrayType,), "LIST"), ((T.StructType, T.MapType), "STRUCT"), ((T.NullType,), "NULL")):
        if isinstance(d, kinds):
            return name
    return "TEXT"


def with_logical(df: DataFrame, **types: str) -> DataFrame:
    for c, t in types.items():
        df = df.withColumn(c, F.col(c).cast(LOGICAL[t])).withMetadata(c, {"logical": t})
    return df


def value_type(kind: Column, value: Column) -> Column:
    """Logical type of one coerced value."""
    return (
        F.when(value.isNull() | (kind == "null"), "NULL").when(kind == "integer", "INTEGER").when(kind == "float", "FLOAT").when(kind == "boolean", "BOOLEAN")
        .when(kind == "decimal", "DECIMAL").when(kind == "date", "DATE").when(kind == "datetime", "DATETIME").otherwise("TEXT")
    )


def widen(types: Column) -> Column:
    """The type that holds all of a set of types."""
    seen = F.array_sort(F.array_distinct(F.filter(types, lambda t: t != "NULL")))
    numeric = F.size(F.array_except(seen, F.array(*map(F.lit, ("INTEGER", "FLOAT", "DECIMAL"))))) == 0
    return (
        F.when(F.size(seen) == 0, "NULL").when(F.size(seen) == 1, F.element_at(seen, 1))
        .when(numeric & F.array_contains(seen, "FLOAT"), "FLOAT").when(numeric, "DECIMAL")
        .when(F.size(F.array_except(seen, F.array(F.lit("DATE"), F.lit("DATETIME")))) == 0, "DATETIME").otherwise("TEXT")
    )


def infer_types(cells: DataFrame, *by: str) -> DataFrame:
    """Type of each group of (kind, value) rows; one partial aggregate of at most a handful of types."""
    return cells.groupBy(*by).agg(widen(F.collect_set(value_type(F.col("kind"), F.col("value")))).alias("type"))


def column_stats(df: DataFrame, samples: int = 5) -> DataFrame:
    """name, type, nulls, filled, distinct values, min, max (as text; NaN apart) and samples (the smallest values, as text) of every column.

    One pass of plain aggregates; distinct values are counted in long form, (column, value) rows that combine before
    the shuffle, instead of one copy of the table a column.
    """
    aggs, names, pairs = [], [], []
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f"`{f.name}`"), logical_type(f)
        ordered = kind in COMPARABLE
        clean = F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c
        aggs += [
            F.count_if(c.isNull()).alias(f"nulls{i}"), F.count(c).alias(f"filled{i}"),
            (F.min(clean).cast("string") if ordered else F.lit(None).cast("string")).alias(f"min{i}"),
            (F.max(clean).cast("string") if ordered else F.lit(None).cast("string")).alias(f"max{i}"),
        ]
        names.append(f"{i}, '{f.name.replace(chr(39), '')}', '{kind}', nulls{i}, filled{i}, min{i}, max{i}")
        shown = F.to_json(c) if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else c.cast("string")
        pairs.append(F.struct(F.lit(i).alias("i"), shown.alias("v")))
    row = df.agg(*aggs).select(F.expr(f"stack({len(names)}, {', '.join(names)}) AS (i, name, type, nulls, filled, min_value, max_value)"))

    def long(t: DataFrame) -> DataFrame:
        return t.select(F.explode(F.array(*pairs)).alias("p")).select("p.i", "p.v").where("v IS NOT NULL")

    once = long(df).groupBy("i", "v").agg(F.lit(1).alias("k"))
    # smallest values by repeated minima would be passes; ranks over distinct values of hash parts keep a few rows a part
    part = once.withColumn("p", F.pmod(F.xxhash64("v"), F.lit(256)))
    few = part.withColumn("r", F.row_number().over(Window.partitionBy("i", "p").orderBy("v"))).groupBy("i", "p").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("r") <= samples, F.col("v"))).alias("vs"))
    got = few.groupBy("i").agg(F.sum("n").alias("distinct_values"), F.slice(F.array_sort(F.flatten(F.collect_list("vs"))), 1, samples).alias("samples"))
    got = row.join(got, "i", "left")
    return got.select("name", "type", "nulls", "filled", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "min_value", "max_value", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def validate(rows: DataFrame, columns: list[str], declared: int | None = None) -> DataFrame:
    """Issues of a table given as (row_ord, cells array): ragged rows, repeated names, a count that is less than the rows."""
    spark = rows.sparkSession
    n = len(columns)
    ragged = rows.where(F.size("cells") != n).select(F.concat(F.lit("row "), F.col("row_ord"), F.lit(" has "), F.size("cells"), F.lit(f" cells, expected {n}")).alias("issue"))
    twice = sorted({c for c in columns if columns.count(c) > 1})
    out = ragged.union(spark.createDataFrame([(f"column name {c} occurs {columns.count(c)} times",) for c in twice], "issue string"))
    if declared is not None:
        out = out.union(rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > declared).select(F.concat(F.lit(f"declared {declared} rows, found "), F.col("n"))))
    return out


def from_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, column_id, ai_value, reviewed_value, ord) to one row a document; reviewed wins, the last write wins; first-seen order in `row_ord`."""
    value = F.coalesce("reviewed_value", "ai_value")
    wide = cells.groupBy("doc_id").pivot("column_id", columns).agg(F.max_by(value, F.col("ord")))
    order = cells.groupBy("doc_id").agg(F.min("ord").alias("row_ord"))
    return wide.join(order, "doc_id")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cut(df: DataFrame, start: int, end: int | None, *order: str) -> DataFrame:
    df = df.orderBy(*order).offset(start)
    return df if end is None else df.limit(max(0, end - start))


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Explicit ordinal of rows, without one task for all: range partitions are counted, then numbered.

    Partitions are written with their number: read from the plan, they could be cut or merged otherwise when they are numbered
    than when they were counted, and rows would be lost.
    """
    part = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "ordinal")
    sizes = part.groupBy("__p").count().withColumn("__from", F.sum("count").over(Window.orderBy("__p")) - F.col("count")).drop("count")
    return part.join(sizes, "__p").withColumn("ord", F.col("__from") + F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1).drop("__p", "__from")


def median(values: DataFrame) -> DataFrame:
    """median of the values (x), exactly, as percentile(x, 0.5), which keeps every distinct value in one place.

    A sketch whose ranks are off by n / 10,000 at most gives bounds around the middle; what is below is counted, and only
    the values between, 0.2 % and what the sketch is off by, are ranked.
    """
    known = values.where("x IS NOT NULL")
    lo, hi = known.agg(F.percentile_approx("x", F.array(F.lit(0.499), F.lit(0.501)), F.lit(10000)).alias("b")).first()[0] or (None, None)
    within = known if lo is None else known.where(F.col("x").between(lo, hi))
    n, below, m = (0, 0, 0) if lo is None else known.agg(F.count("x"), F.count_if(F.col("x") < lo), F.count_if(F.col("x").between(lo, hi))).first()
    at = (n - 1) / 2 - below
    if not m or at < 0 or at > m - 1:  # nothing there, or the sketch was further off than it says
        return known.agg(F.percentile("x", F.lit(0.5)).alias("median"))
    return within.agg(F.percentile("x", F.lit(at / (m - 1) if m > 1 else 0.0)).alias("median"))


def search_tabular(df: DataFrame, name: str, query: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """Cells that hold the query, case folded: 2.0 for the whole cell, 1.0 for a part; with the cell's address."""
    cols = [c for c in df.columns if columns is None or c in columns]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.select(F.col(key).alias("row_key"), F.expr(f"stack({len(cols)}, {pairs}) AS (col, value)"))
    q = query.lower()
    return (
        long.where(F.lower("value").contains(q))
        .select("row_key", "col", "value", F.when(F.lower("value") == q, 2.0).otherwise(1.0).alias("score"), F.concat(F.lit(f"#/tables/{name}/rows/"), F.col("row_key"), F.lit("/"), F.col("col")).alias("ref"))
    )

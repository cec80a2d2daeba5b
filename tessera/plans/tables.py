"""Queries on tables: profiles, inference, coercion, pivots, slices, cell search, serialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.operators import tabular as B
from tessera.session import table
from tessera.sources import serialize as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stats_sql(name: str, kind: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"""SELECT '{name}' AS name, '{kind}' AS type, count(*) - count({name}) AS nulls, count({name}) AS filled, count(DISTINCT {name}) AS distinct_values, CAST(min({name}) AS VARCHAR) AS min_value,
CAST(max({name}) AS VARCHAR) AS max_value, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {text} v FROM orders ORDER BY v LIMIT 5)) AS samples FROM orders"""


_ORDERS = {"o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_orderstatus": "TEXT", "o_totalprice": "FLOAT", "o_orderdate": "DATETIME", "o_orderpriority": "TEXT"}


@query(" UNION ALL ".join(_stats_sql(n, k) for n, k in _ORDERS.items()))
def table_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.column_stats(table(spark, sf_dir, "orders")).withColumn("samples", F.array_join("samples", "|"))


@query("""SELECT 'c_custkey' AS name, count(c_custkey) AS filled, count(DISTINCT c_custkey) AS distinct_values FROM customer UNION ALL SELECT 'c_name', count(c_name), count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer""")
def table_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.column_stats(table(spark, sf_dir, "customer"), samples=3).select("name", "filled", "distinct_values")


@query("""SELECT source, CASE WHEN bool_and(regexp_matches(v, '^[0-9]+$')) THEN 'INTEGER' WHEN bool_and(regexp_matches(v, '^[0-9]+(\\.[0-9]+)?$')) THEN 'FLOAT' ELSE 'TEXT' END AS type
FROM (SELECT source, CAST(n_chars AS VARCHAR) v FROM documents UNION ALL SELECT 'price', CAST(p_retailprice AS VARCHAR) FROM part UNION ALL SELECT 'brand', p_brand FROM part) GROUP BY source""")
def table_infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    cells = d.select("source", F.col("n_chars").cast("string").alias("v")).union(p.select(F.lit("price"), F.col("p_retailprice").cast("string"))).union(p.select(F.lit("brand"), "p_brand"))
    c = N.coerce_value(F.col("v"))
    return B.infer_types(cells.select("source", c["kind"].alias("kind"), c["value"].alias("value")), "source")


@query("""SELECT p_partkey, 'integer' AS kind, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'text', p_name FROM part UNION ALL SELECT p_partkey, 'integer', CAST(1000 + p_size AS VARCHAR) FROM part""")
def scalar_coerce_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cells = p.select("p_partkey", F.explode(F.array(F.concat(F.lit(" $"), F.col("p_size").cast("string")), "p_name", F.format_number(F.col("p_size") + 1000, 0))).alias("v"))
    c = N.coerce_value(F.col("v"))
    return cells.select("p_partkey", c["kind"].alias("kind"), c["value"].alias("value"))


@query("""SELECT o_custkey AS doc_id, arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS "F", arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS "O", arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS "P", min(o_orderkey) AS row_ord FROM orders GROUP BY o_custkey""")
def table_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cells = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("column_id"), F.col("o_orderkey").alias("ai_value"), F.lit(None).cast("long").alias("reviewed_value"), F.col("o_orderkey").alias("ord"))
    return B.from_cells(cells, ["F", "O", "P"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10")
def table_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.head(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 10, "p_partkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 20")
def table_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cut(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 20, 50, "p_partkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ord FROM orders")
def table_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_ordinal(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "ord")


@query("SELECT p_brand AS name FROM part GROUP BY p_brand")
def table_column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()


_CELLS = "SELECT p_partkey AS row_key, col, value FROM (SELECT p_partkey, 'p_name' AS col, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part)"


@query(f"SELECT row_key, col, value, CASE WHEN lower(value) = 'red' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score, '#/tables/part/rows/' || row_key || '/' || col AS ref FROM ({_CELLS}) WHERE contains(lower(value), 'red')")
def search_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.search_tabular(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "part", "red", "p_partkey", ["p_name", "p_brand", "p_type"])


@query("SELECT n_nationkey, n_nationkey || ',' || CASE WHEN contains(n_name, ',') OR contains(n_name, '\"') THEN '\"' || replace(n_name, '\"', '\"\"') || '\"' ELSE n_name END || ',' || n_regionkey AS line FROM nation")
def serialize_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", S.csv_line([("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")], ",").alias("line"))


@query("SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS json FROM region")
def serialize_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.json_records(table(spark, sf_dir, "region"), "r_regionkey")


@query("""WITH t AS (SELECT CAST(r_regionkey AS VARCHAR) a, r_name b FROM region), w AS (SELECT greatest(3, length('r_regionkey'), max(length(a))) wa, greatest(3, length('r_name'), max(length(b))) wb FROM t)
SELECT '| ' || rpad('r_regionkey', CAST(wa AS INTEGER), ' ') || ' | ' || rpad('r_name', CAST(wb AS INTEGER), ' ') || ' |' || chr(10) || '| ' || repeat('-', wa) || ' | ' || repeat('-', wb) || ' |' || chr(10) ||
(SELECT string_agg('| ' || rpad(a, CAST(wa AS INTEGER), ' ') || ' | ' || rpad(b, CAST(wb AS INTEGER), ' ') || ' |', chr(10) ORDER BY a) FROM t) AS markdown FROM w""")
def serialize_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markdown_table(table(spark, sf_dir, "region"), "r_regionkey")

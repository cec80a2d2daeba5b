"""The SQL surface over registered tables: one query a class of join, aggregate, window, set operation and function.

Most texts are valid in both dialects; where they differ the oracle's text is given beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import containing
from tessera.operators.sqlfacade import Database
from tessera.operators.tabular import median
from tessera.session import table, texts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = {}, {}


def _add(name: str, sql: str, oracle: str | None = None, **spark_for: str) -> None:
    used = [t for t in TABLES if t in sql]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark)
        for t in used:
            db.register(t, table(spark, sf_dir, t))
        return db.query(sql)

    QUERIES[f"sql_{name}"] = run
    SQL[f"sql_{name}"] = oracle or sql


_add("filter_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
_add("group_by", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
_add("having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 5")
_add("join_inner", """SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY c_mktsegment, o_orderpriority""")
_add("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_add("join_full", """SELECT count(*) AS n, count(c.c_custkey) AS customers, count(s.s_suppkey) AS suppliers FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c
FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c.c_custkey = s.s_suppkey""")
_add("join_right", "SELECT n_name, r_name FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
_add("join_cross", "SELECT r_name, c_mktsegment, count(*) AS n FROM region CROSS JOIN customer GROUP BY r_name, c_mktsegment")
_add("join_range", """SELECT b.band, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part JOIN (VALUES ('s', 1, 10), ('m', 11, 30), ('l', 31, 100)) AS b(band, lo, hi)
ON p_size BETWEEN b.lo AND b.hi GROUP BY b.band""")
_add("join_semi", "SELECT p_partkey, p_name FROM part LEFT SEMI JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 49", "SELECT p_partkey, p_name FROM part SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity >= 49) ON l_partkey = p_partkey")
_add("join_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000", "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey")
_add("exists", "SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09 AND l.l_quantity > 49)")
_add("not_in", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 AND s_suppkey < 20)")
_add("scalar_subquery", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.05 FROM part)")
_add("correlated_subquery", """SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_totalprice > (SELECT 2 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
_add("cte", "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM spent WHERE total > 3000000) SELECT c_name, round(total, 2) AS total FROM top JOIN customer ON c_custkey = o_custkey")
_add("asof_join", """SELECT event_id, user_id, event_type, last_click FROM (
SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events)
WHERE event_type = 'purchase'""", """SELECT event_id, user_id, event_type, last_click FROM (
SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events)
WHERE event_type = 'purchase'""")
_add("distinct", "SELECT DISTINCT p_brand, p_type FROM part")
_add("grouping_sets", "SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
     "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_add("rollup", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
_add("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_add("filter_aggregate", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS spent FROM events GROUP BY user_id")
_add("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
_add("quantiles", "SELECT c_mktsegment, round(percentile(c_acctbal, 0.5), 4) AS median, round(percentile(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY c_mktsegment",
     "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY c_mktsegment")
_add("variance", "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, round(var_pop(p_retailprice), 4) AS vp, round(corr(p_size, p_retailprice), 6) AS r FROM part GROUP BY p_brand")
_add("arg_max", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS largest FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) AS largest FROM orders GROUP BY o_custkey")
_add("string_agg", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_add("bool_agg", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_totalprice > 499000) AS any_one FROM orders GROUP BY o_orderpriority")
_add("rank", """SELECT * FROM (SELECT n_regionkey, s_suppkey, s_acctbal, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM supplier JOIN nation ON s_nationkey = n_nationkey
WINDOW w AS (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey)) WHERE rn <= 5""", """SELECT * FROM (SELECT n_regionkey, s_suppkey, s_acctbal, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr FROM supplier JOIN nation ON s_nationkey = n_nationkey
WINDOW w AS (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey)) WHERE rn <= 5""")
_add("ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 6) AS pr FROM customer",
     "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS q, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 6) AS pr FROM customer")
_add("lag_lead", "SELECT event_id, lag(event_type, 1) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
_add("running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM orders")
_add("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM events")
_add("range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS near FROM lineitem")
_add("first_last", "SELECT DISTINCT user_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER w AS last_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_add("union_all", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
_add("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
_add("except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
_add("except_all", "SELECT p_brand FROM part EXCEPT ALL SELECT p_brand FROM part WHERE p_size > 20")
_add("intersect_all", "SELECT p_type FROM part WHERE p_size > 20 INTERSECT ALL SELECT p_type FROM part WHERE p_size < 15")
_add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_add("offset", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 25")
_add("pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
     "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
_add("unpivot", "SELECT s_suppkey, k, v FROM (SELECT s_suppkey, s_acctbal AS bal, CAST(s_nationkey AS DOUBLE) AS nat FROM supplier) UNPIVOT (v FOR k IN (bal, nat))",
     "SELECT s_suppkey, 'bal' AS k, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nat', CAST(s_nationkey AS DOUBLE) FROM supplier")
_add("unnest", "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, explode(split(text, ' ')) AS word FROM documents) WHERE word = 'the' OR word = 'der' GROUP BY doc_id, word",
     "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word = 'the' OR word = 'der' GROUP BY doc_id, word")
_add("case_coalesce", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, coalesce(nullif(p_type, 'ECONOMY'), 'none') AS t, greatest(p_size, 10) AS g, least(p_size, 10) AS l FROM part")
_add("strings", "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 10, 4) AS s, length(c_name) AS n, replace(c_name, '#', '-') AS r, lpad(CAST(c_nationkey AS STRING), 4, '0') AS p, reverse(c_mktsegment) AS v, instr(c_name, '#') AS i FROM customer",
     "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 10, 4) AS s, CAST(length(c_name) AS INTEGER) AS n, replace(c_name, '#', '-') AS r, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS p, reverse(c_mktsegment) AS v, CAST(instr(c_name, '#') AS INTEGER) AS i FROM customer")
_add("regex", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_name, '[aeiou]', '_') AS r FROM part WHERE p_name RLIKE '^(red|blue).*'",
     "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r FROM part WHERE regexp_matches(p_name, '^(red|blue).*')")
_add("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%green%' OR p_name ILIKE 'RED%'")
_add("dates", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, count(*) AS n, max(datediff(TIMESTAMP '2003-01-01 00:00:00', o_orderdate)) AS age FROM orders GROUP BY year(o_orderdate), month(o_orderdate), quarter(o_orderdate)",
     "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, count(*) AS n, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), DATE '2003-01-01')) AS INTEGER) AS age FROM orders GROUP BY 1, 2, 3")
_add("date_trunc", "SELECT date_trunc('HOUR', ts) AS h, event_type, count(*) AS n FROM events GROUP BY date_trunc('HOUR', ts), event_type", "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_add("math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(ln(p_size + 1), 6) AS l, p_size % 7 AS m, floor(p_retailprice / 100) AS f, abs(p_size - 25) AS a, round(power(p_size, 1.5), 4) AS w FROM part",
     "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(ln(p_size + 1), 6) AS l, p_size % 7 AS m, CAST(floor(p_retailprice / 100) AS BIGINT) AS f, abs(p_size - 25) AS a, round(power(p_size, 1.5), 4) AS w FROM part")
_add("json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_add("arrays", "SELECT vec_id, size(embedding) AS n, round(CAST(element_at(embedding, 1) AS DOUBLE), 6) AS first, round(CAST(array_max(embedding) AS DOUBLE), 6) AS top, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings",
     "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings")
_add("hashes", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
_add("null_handling", "SELECT count(*) AS n, count(q) AS known, sum(CASE WHEN q IS NULL THEN 1 ELSE 0 END) AS missing, count(DISTINCT coalesce(q, -1)) AS kinds FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
     "SELECT count(*) AS n, count(q) AS known, CAST(sum(CASE WHEN q IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(DISTINCT coalesce(q, -1)) AS kinds FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
_add("conversation_turns", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv_id) AS turns, length(text) AS n FROM conversations",
     "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv_id) AS turns, CAST(length(text) AS INTEGER) AS n FROM conversations")
_add("benchmark_exact", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
_add("maps", "SELECT c_custkey, map_keys(m)[0] AS first_key, element_at(m, 'b') AS b, size(m) AS n, map_contains_key(m, 'z') AS z FROM (SELECT c_custkey, map('a', c_acctbal, 'b', c_nationkey * 1.0D) AS m FROM customer)",
     "SELECT c_custkey, 'a' AS first_key, c_nationkey * 1.0::DOUBLE AS b, 2 AS n, FALSE AS z FROM customer")
_add("approximate", "SELECT abs(approx_count_distinct(o_custkey, 0.01) - count(DISTINCT o_custkey)) <= 0.05 * count(DISTINCT o_custkey) AS near, abs(percentile_approx(o_totalprice, 0.5, 10000) - percentile(o_totalprice, 0.5)) <= 0.01 * percentile(o_totalprice, 0.5) AS middle FROM orders",
     "SELECT TRUE AS near, TRUE AS middle")


def benchmark_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id of texts that hold an item's text, whatever stands around it."""
    return containing(texts(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sketches come near the exact figures. Each is an aggregate of its own: beside a distinct count, one sketch a customer was kept."""
    o = table(spark, sf_dir, "orders")
    sketch = o.agg(F.approx_count_distinct("o_custkey", 0.01).alias("a"), F.percentile_approx("o_totalprice", F.lit(0.5), F.lit(10000)).alias("p"))
    exact = o.agg(F.count_distinct("o_custkey").alias("d"))
    near, middle = F.abs(F.col("a") - F.col("d")) <= 0.05 * F.col("d"), F.abs(F.col("p") - F.col("m")) <= 0.01 * F.col("m")
    return sketch.crossJoin(exact).crossJoin(median(o.select(F.col("o_totalprice").cast("double").alias("x"))).select(F.col("median").alias("m"))).select(near.alias("near"), middle.alias("middle"))


QUERIES["sql_benchmark_exact"], QUERIES["sql_approximate"] = benchmark_exact, approximate

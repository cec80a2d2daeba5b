"""Queries on annotations, redaction, extracted tables, stored tables and page structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import layout as L
from tessera.plans.analysis import _BOX, LINES, _boxes
from tessera.plans.docs import BLOCKS, line_blocks
from tessera.session import materialize, table, texts
from tessera.sources import html, nodes, serialize, store

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_MARKS = "SELECT event_id AS ann_id, user_id AS doc_id, '#/body/' || (event_id % 3) AS node_ref, CASE WHEN event_id % 5 > 0 THEN event_id % 40 END AS s, CASE WHEN event_id % 5 > 0 THEN event_id % 40 + 8 END AS e FROM events"


@query(f"SELECT m.ann_id, m.doc_id, o.x AS \"offset\" FROM ({_MARKS}) m, (VALUES (5), (20), (33)) o(x) WHERE coalesce(m.s, 0) <= o.x AND (m.e IS NULL OR o.x < m.e)")
def annotation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 40
    marks = table(spark, sf_dir, "events").select(F.col("event_id").alias("ann_id"), F.col("user_id").alias("doc_id"), F.concat(F.lit("#/body/"), F.col("event_id") % 3).alias("node_ref"), F.when(F.col("event_id") % 5 > 0, k).alias("start"), F.when(F.col("event_id") % 5 > 0, k + 8).alias("end"))
    points = marks.select("doc_id", "node_ref").distinct().select("doc_id", "node_ref", F.explode(F.array(F.lit(5), F.lit(20), F.lit(33))).alias("offset"))
    return nodes.annotations_at(marks, points).select("ann_id", "doc_id", "offset")


@query(f"WITH {BLOCKS} SELECT doc_id, body_index, CASE WHEN body_index % 4 = 1 THEN substring(text, 1, 3) || '[REDACTED]' || substring(text, 10) WHEN body_index % 4 = 2 THEN '[REDACTED]' ELSE text END AS text FROM b")
def redact_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = line_blocks(spark, sf_dir)
    i = F.col("body_index") % 4
    marks = b.where(i.isin(1, 2)).select("doc_id", "body_index", F.when(i == 1, 3).alias("start"), F.when(i == 1, 9).alias("end"))
    return serialize.redact(b, marks).select("doc_id", "body_index", "text")


@query("SELECT page_id AS doc_id, count(*) AS cells FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY page_id")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' link lists, rewritten as tables."""
    page = F.col("html")
    for a, b in (("<nav>", "<div>"), ("</nav>", "</div>"), ("<ul>", "<table><tr>"), ("</ul>", "</tr></table>"), ("<li>", "<td>"), ("</li>", "</td>")):
        page = F.replace(page, F.lit(a), F.lit(b))
    found = nodes.parse(texts(spark, sf_dir, "pages").select("page_id", page.alias("html")), html.parse_html, "page_id", "html")
    return nodes.table_cells(materialize(found, "nodes")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def store_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.from_artifact(spark, store.to_artifact(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "supplier"))


@query(f"""WITH {_BOX}, g AS (SELECT page, lo, hi, unnest(range(0, CAST(greatest(1, ceil(hi - lo)) AS BIGINT))) AS bin FROM e), p AS (SELECT g.page, g.lo, g.hi, g.bin, count(x.page) AS w FROM g LEFT JOIN x ON x.page = g.page AND g.bin >= floor(x.l - g.lo) AND g.bin < ceil(x.r - g.lo) GROUP BY ALL),
m AS (SELECT page, max(w) * 0.1::DOUBLE mw FROM p GROUP BY page), k AS (SELECT page, lo, hi, bin, bin - row_number() OVER (PARTITION BY page ORDER BY bin) k FROM p JOIN m USING (page) WHERE w <= mw), v AS (SELECT page, lo, min(bin) s, max(bin) + 1 e FROM k GROUP BY page, lo, k HAVING count(*) >= 10),
c AS (SELECT page, lo + s AS x, lo + e AS n FROM v UNION ALL SELECT page, hi, NULL FROM e), d AS (SELECT c.page, coalesce(lag(n) OVER (PARTITION BY c.page ORDER BY n NULLS LAST), e.lo) AS "left", x AS "right" FROM c JOIN e ON e.page = c.page)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY "left") AS INTEGER) AS n, "left", "right" FROM d WHERE "right" > "left\"""")
def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.detect_columns(_boxes(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.group_into_lines(_boxes(spark, sf_dir))


_GAPS = f"""{LINES}, r AS (SELECT page, line, min(t) t, max(b) b FROM ln GROUP BY 1, 2), h AS (SELECT page, line, t - lag(b) OVER (PARTITION BY page ORDER BY line) gap FROM r),
m AS (SELECT page, count(*) n, max(gap) widest, list_sort(list(gap))[CAST(floor(count(*) / 2) AS INTEGER) + 1] med FROM h WHERE gap IS NOT NULL GROUP BY page),
o AS (SELECT page, gap x, count(*) n FROM h WHERE gap IS NOT NULL GROUP BY 1, 2), s AS (SELECT page, x, lead(x) OVER w nx, sum(n) OVER w n0, sum(x * n) OVER w s0, sum(n) OVER (PARTITION BY page) nn, sum(x * n) OVER (PARTITION BY page) ss FROM o WINDOW w AS (PARTITION BY page ORDER BY x)),
y AS (SELECT page, (x + nx) / 2 th, nn - n0 above, row_number() OVER (PARTITION BY page ORDER BY round(n0 * (nn - n0) / CAST(nn * nn AS DOUBLE) * pow(s0 / n0 - (ss - s0) / (nn - n0), 2), 9) DESC, x) k FROM s WHERE nx IS NOT NULL)"""


def _breaks(method: str, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _placed(spark, sf_dir).groupBy("page", "line").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))
        return L.paragraph_breaks(lines, method)

    name = f"layout_paragraph_breaks_{method}"
    QUERIES[name] = run
    SQL[name] = f"WITH {_GAPS} SELECT page, line, coalesce(widest > 0 AND NOT (med > 0 AND widest / med < 1.3) AND {condition}, FALSE) AS breaks FROM h LEFT JOIN m USING (page) LEFT JOIN (SELECT * FROM y WHERE k = 1) y USING (page)"


for _m, _c in (("otsu", "gap >= th AND above <= 0.8 * n"), ("relative", "gap >= med * 1.5"), ("jenks", "gap > th")):
    _breaks(_m, _c)


@query(f"""WITH {LINES}, c AS (SELECT page, l, count(DISTINCT line) k FROM ln GROUP BY 1, 2 HAVING count(DISTINCT line) >= 2), w AS (SELECT page, line FROM ln SEMI JOIN c USING (page, l) GROUP BY 1, 2 HAVING count(DISTINCT l) >= 2),
i AS (SELECT page, line, line - row_number() OVER (PARTITION BY page ORDER BY line) k FROM w), r AS (SELECT page, k, count(DISTINCT line) n, min(l) AS "left", min(t) AS top, max(r) AS "right", max(b) AS bottom FROM ln JOIN i USING (page, line) GROUP BY 1, 2)
SELECT page, "left", top, "right", bottom FROM r WHERE n >= 2""")
def layout_table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_regions(_placed(spark, sf_dir))

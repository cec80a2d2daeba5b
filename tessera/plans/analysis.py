"""Queries on duplicates, clusters, chunks, comparisons, layout and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.wordlists import STOPWORDS
from tessera.operators import chunking as H
from tessera.operators import cluster as C
from tessera.operators import dedup as D
from tessera.operators import diff as X
from tessera.operators import layout as L
from tessera.operators.graph import connected_components
from tessera.plans.docs import line_blocks
from tessera.session import table, texts
from tessera.streaming import events as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text", F.col("text").cast("binary").alias("content"))


@query("""WITH k AS (SELECT doc_id AS ord, sha256(text) h FROM documents), g AS (SELECT h, min(ord) canonical FROM k GROUP BY h HAVING count(*) > 1)
SELECT 'binary' AS level, 'binary_' || left(h, 16) AS cluster_id, canonical, ord AS member, CAST(row_number() OVER (PARTITION BY h ORDER BY ord) - 1 AS INTEGER) AS member_ord, 1.0::DOUBLE AS similarity FROM k JOIN g USING (h)""")
def dedup_binary_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.binary_hash(_docs(spark, sf_dir))


SHINGLES = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
z AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, o / CAST(x.n + y.n - o AS DOUBLE) j FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE o * 10 >= 8 * (x.n + y.n - o))"""
REACH = """u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT a, a FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a), c AS (SELECT x AS node, min(y) AS component FROM r GROUP BY x)"""


@query(f"WITH RECURSIVE {SHINGLES}, {REACH} SELECT component AS canonical, node AS member, CAST(row_number() OVER (PARTITION BY component ORDER BY node) - 1 AS INTEGER) AS member_ord FROM c")
def dedup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.minhash(_docs(spark, sf_dir)).select("canonical", "member", "member_ord")


@query(f"WITH {SHINGLES} SELECT a, b, round(j, 6) AS jaccard FROM e")
def dedup_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    # the clusters need a spanning set of edges only; the full join of equal sets completes the pairs
    sets = d.select("ord", D.shingles(F.col("text")).alias("s")).where(F.size("s") > 0).withColumn("id", F.xxhash64("s"))
    rep = sets.groupBy("id").agg(F.min("ord").alias("rep"))
    of = sets.select("ord", "id").join(rep, "id").select("ord", "rep")
    pairs = D.similar_pairs(sets.select("ord", "s"), 80).where("jaccard < 1 OR a <> b")
    near = pairs.join(of.select(F.col("ord").alias("x"), F.col("rep").alias("a")), "a").join(of.select(F.col("ord").alias("y"), F.col("rep").alias("b")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    same = of.alias("p").join(of.alias("q"), F.expr("p.rep = q.rep AND p.ord < q.ord")).select(F.col("p.ord").alias("a"), F.col("q.ord").alias("b"), F.lit(1.0).alias("jaccard"))
    return near.union(same).select("a", "b", F.round("jaccard", 6).alias("jaccard")).distinct()


@query()
def dedup_fuzzy_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fuzzy_binary(_docs(spark, sf_dir)).select("canonical", "member", "member_ord", F.round("similarity", 6).alias("similarity"))


_HASH = "list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / 64 THEN 1 ELSE 0 END)"


@query(f"WITH h AS (SELECT vec_id, {_HASH} b FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2]))) AS INTEGER) AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2]))) <= 18")
def dedup_perceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hamming_pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), D.average_hash(F.col("embedding")).alias("h")), 18)


_E = "e AS (SELECT a.vec_id a, b.vec_id b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) >= 0.42)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"WITH {_E} SELECT a, b FROM e")
def dedup_cosine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cosine_edges(_vectors(spark, sf_dir), 0.42).select("a", "b")


@query(f"WITH RECURSIVE {_E}, {REACH} SELECT component AS canonical, node AS member FROM c")
def dedup_semantic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.semantic_graph(_vectors(spark, sf_dir), 0.42).select("canonical", "member")


@query()
def dedup_semantic_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.semantic(_vectors(spark, sf_dir), 0.6).select("canonical", "member", F.round("similarity", 6).alias("similarity"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey a, c_custkey + 1000000 + 7 * (c_nationkey + 1) b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, a FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a) SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1000000 + 7 * (F.col("c_nationkey") + 1)).alias("dst"))
    return connected_components(e)


def _canonical(rule: str, order: str) -> None:
    sql = f"""WITH k AS (SELECT source, doc_id, text FROM documents) SELECT source AS cluster_id, doc_id AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {order}doc_id) r FROM k) WHERE r = 1"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = texts(spark, sf_dir, "documents")
        c = d.select(F.lit("x").alias("level"), F.col("source").alias("cluster_id"), F.lit(0).cast("long").alias("canonical"), F.col("doc_id").alias("member"), F.lit(0).alias("member_ord"), F.lit(1.0).alias("similarity"))
        return D.recanonicalize(c, d.select(F.col("doc_id").alias("ord"), "text"), rule).select("cluster_id", "canonical").distinct()

    QUERIES[f"canonical_{rule}"], SQL[f"canonical_{rule}"] = run, sql


for _r, _o in (("first", ""), ("longest", "length(text) DESC, "), ("shortest", "length(text), ")):
    _canonical(_r, _o)


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(v * v)) n FROM x GROUP BY vec_id), y AS (SELECT label, x.vec_id, i, v / n v FROM x JOIN n USING (vec_id)),
c AS (SELECT label, i, avg(v) c FROM y GROUP BY 1, 2), s AS (SELECT label, y.vec_id, round(sum(v * c), 9) s FROM y JOIN c USING (label, i) GROUP BY 1, 2) SELECT CAST(label AS VARCHAR) AS cluster_id, vec_id AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) r FROM s) WHERE r = 1""")
def canonical_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    c = e.select(F.lit("x").alias("level"), F.col("label").cast("string").alias("cluster_id"), F.lit(0).cast("long").alias("canonical"), F.col("vec_id").alias("member"), F.lit(0).alias("member_ord"), F.lit(1.0).alias("similarity"))
    return D.recanonicalize(c, e.select(F.col("vec_id").alias("ord"), "embedding"), "medoid").select("cluster_id", "canonical").distinct()


@query(f"WITH RECURSIVE t AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) m, count(*) OVER (PARTITION BY lower(text)) k FROM documents), {SHINGLES.replace('FROM documents)', 'FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t WHERE k > 1))')}, {REACH} SELECT 'text' AS level, m AS canonical, doc_id AS member FROM t WHERE k > 1 UNION ALL SELECT 'minhash', component, node FROM c")
def dedup_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.run(_docs(spark, sf_dir)).select("level", "canonical", "member")


@query("""WITH t AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) m, count(*) OVER (PARTITION BY lower(text)) k FROM documents), a AS (SELECT count(*) FILTER (WHERE k > 1) members, count(DISTINCT m) FILTER (WHERE k > 1) clusters, count(*) total FROM t)
SELECT total, clusters, members, total - members AS singletons, total - members + clusters AS "unique", round((members - clusters) / CAST(total AS DOUBLE), 6) AS rate FROM a""")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return D.report(D.run(d, D.FAST), d)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("ord"), F.col("quality").cast("long").alias("cluster_id"), "text")


def _ctfidf_sql() -> str:
    from tessera.plans.docs import _T, _stop_sql

    return rf"""WITH s AS (SELECT quality, list_filter({_T}, lambda x: NOT list_contains([{_stop_sql()}], x)) ts FROM documents JOIN labels USING (doc_id)),
t AS (SELECT quality, unnest(ts) term FROM s UNION ALL SELECT quality, unnest(list_transform(range(1, len(ts)), lambda i: array_to_string(ts[i:i + 1], ' '))) FROM s WHERE len(ts) >= 2),
f AS (SELECT term, count(*) f FROM t GROUP BY term HAVING count(*) >= 3), c AS (SELECT quality, term, count(*) tf FROM t GROUP BY 1, 2), z AS (SELECT quality, sum(tf) size FROM c GROUP BY 1),
s2 AS (SELECT quality, term, tf / CAST(size AS DOUBLE) * ln(1 + (SELECT avg(size) FROM z) / f) s FROM c JOIN f USING (term) JOIN z USING (quality))
SELECT CAST(quality AS BIGINT) AS cluster_id, CAST(rank AS INTEGER) AS rank, term, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY round(s, 12) DESC, term) rank FROM s2) WHERE rank <= 10"""


@query(_ctfidf_sql())
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_clusters(_labelled(spark, sf_dir), 10, min_df=3, stopwords=STOPWORDS).withColumn("score", F.round("score", 9))


@query()
def cluster_labels_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_clusters(_labelled(spark, sf_dir), 10, diversity=0.3, min_df=3, stopwords=STOPWORDS, token_prefix=6).withColumn("score", F.round("score", 9))


@query("SELECT CAST(quality AS BIGINT) AS cluster_id, count(*) AS size, arg_max(doc_id, length(text) * 1000000 - doc_id) AS exemplar FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def cluster_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exemplars(_labelled(spark, sf_dir))


@query()
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.chunk(line_blocks(spark, sf_dir), 2, 2000, breadcrumbs=True)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", r"(?<=\.) ").alias("b"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("b").alias("rev"))
    return c.join(n, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("b").alias("orig"), "rev")


@query()
def diff_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.compare(_turns(spark, sf_dir))


_TURNS = "SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS o, b.text AS r FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"


@query(f"SELECT pair_id, r AS text FROM ({_TURNS})")
def revision_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.view(X.compare(_turns(spark, sf_dir)), "final").select("pair_id", F.array_join("blocks", " ").alias("text"))


@query(f"SELECT pair_id, o AS text FROM ({_TURNS})")
def revision_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.view(X.reject_all(X.compare(_turns(spark, sf_dir))), "markup").select("pair_id", F.array_join("blocks", " ").alias("text"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("user"), F.col("user_id") % 5).alias("author"), F.when(F.col("event_type") == "click", "ins").when(F.col("event_type") == "purchase", "del").when(F.col("event_type") == "error", "move_to").otherwise("keep").alias("change"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("date"), F.lit("x").alias("text"))


_CHANGES = "SELECT event_id, 'user' || (user_id % 5) AS author, CASE event_type WHEN 'click' THEN 'ins' WHEN 'purchase' THEN 'del' WHEN 'error' THEN 'move_to' ELSE 'keep' END AS change, CASE WHEN event_id % 9 <> 0 THEN ts END AS date FROM events"


@query(f"SELECT author, count(*) FILTER (WHERE change = 'ins') AS ins, count(*) FILTER (WHERE change = 'del') AS del, count(*) FILTER (WHERE change = 'move_from') AS move_from, count(*) FILTER (WHERE change = 'move_to') AS move_to FROM ({_CHANGES}) WHERE change <> 'keep' GROUP BY author")
def revision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.summary(_changes(spark, sf_dir))


@query(f"SELECT event_id, 'keep' AS change FROM ({_CHANGES}) WHERE change = 'keep' OR (coalesce(date <= TIMESTAMP '2024-01-03 00:00:00', FALSE) AND change <> 'del') OR (NOT coalesce(date <= TIMESTAMP '2024-01-03 00:00:00', FALSE) AND change = 'del')")
def revision_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.at_time(_changes(spark, sf_dir), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).select("event_id", "change")


@query(f"SELECT event_id, CASE WHEN author = 'user1' THEN 'keep' ELSE change END AS change FROM ({_CHANGES}) WHERE author <> 'user1' OR change <> 'del'")
def revision_accept_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.by_author(_changes(spark, sf_dir), "user1", "accept").select("event_id", "change")


@query(f"SELECT event_id FROM ({_CHANGES}) WHERE date BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-02 00:00:00'")
def revision_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 06:00:00", "2024-01-02 00:00:00")]
    return X.between(_changes(spark, sf_dir), *t).select("event_id")


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))


@query("SELECT k, id, CAST(sum(gap) OVER (PARTITION BY k ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM (SELECT c_nationkey::BIGINT AS k, c_custkey AS id, c_acctbal AS x, CASE WHEN c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) > 150 THEN 1 ELSE 0 END AS gap FROM customer)")
def layout_cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cluster_1d(_balances(spark, sf_dir), 150.0, "k").select("k", "id", "g")


@query("""WITH o AS (SELECT c_nationkey::BIGINT k, c_acctbal x, count(*) n FROM customer GROUP BY 1, 2), s AS (SELECT k, x, lead(x) OVER w nx, sum(n) OVER w n0, sum(x * n) OVER w s0, sum(n) OVER (PARTITION BY k) nn, sum(x * n) OVER (PARTITION BY k) ss FROM o WINDOW w AS (PARTITION BY k ORDER BY x)),
v AS (SELECT k, (x + nx) / 2 t, round(n0 * (nn - n0) / CAST(nn * nn AS DOUBLE) * pow(s0 / n0 - (ss - s0) / (nn - n0), 2), 3) var, n0, nn - n0 n1 FROM s WHERE nx IS NOT NULL)
SELECT k, round(t, 4) AS threshold, CAST(n0 AS BIGINT) AS below, CAST(n1 AS BIGINT) AS above FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY var DESC, t) r FROM v) WHERE r = 1""")
def layout_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.otsu(_balances(spark, sf_dir), "k").select("k", F.round("threshold", 4).alias("threshold"), "below", "above")


@query("""WITH b AS (SELECT CAST(floor((p_size - (SELECT min(p_size) FROM part)) / 3.0::DOUBLE) AS BIGINT) b, count(*) n FROM part GROUP BY 1), w AS (SELECT *, CASE WHEN lag(b) OVER (ORDER BY b) = b - 1 THEN lag(n) OVER (ORDER BY b) ELSE 0 END l, CASE WHEN lead(b) OVER (ORDER BY b) = b + 1 THEN lead(n) OVER (ORDER BY b) ELSE 0 END r FROM b)
SELECT (SELECT min(p_size) FROM part) + (b + 0.5::DOUBLE) * 3.0::DOUBLE AS mode, n FROM w WHERE n >= l AND n >= r""")
def layout_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.modes(table(spark, sf_dir, "part").select(F.lit(0).alias("k"), F.col("p_size").cast("double").alias("x")), 3.0, "k").drop("k")


@query("""WITH o AS (SELECT c_nationkey::BIGINT k, c_acctbal x, count(*) n FROM customer GROUP BY 1, 2), p AS (SELECT k, x, sum(n) OVER w n, sum(n * x) OVER w s, sum(n * x * x) OVER w q, row_number() OVER w i FROM o WINDOW w AS (PARTITION BY k ORDER BY x)),
z AS (SELECT k, arg_max(n, i) n, arg_max(s, i) s, arg_max(q, i) q, max(x) x, max(i) m FROM p GROUP BY k), c AS (SELECT a.k, a.x ax, b.x bx, z.x zx, a.q - a.s * a.s / a.n + (b.q - a.q) - pow(b.s - a.s, 2) / (b.n - a.n) + (z.q - b.q) - pow(z.s - b.s, 2) / (z.n - b.n) v FROM p a JOIN p b ON a.k = b.k AND a.i < b.i JOIN z ON z.k = a.k AND b.i < z.m),
w AS (SELECT k, arg_min([ax, bx, zx], round(v, 4)) u FROM c GROUP BY k UNION ALL SELECT k, list(x ORDER BY x) FROM p GROUP BY k HAVING count(*) < 3)
SELECT k AS g, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS class, unnest(u) AS upper FROM w""")
def layout_jenks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.jenks_breaks(_balances(spark, sf_dir), 3, "k")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top = F.col("l_quantity") * 10, F.floor(F.col("l_extendedprice") / 100) * 20
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), left.alias("left"), top.cast("double").alias("top"), (left + 8).alias("right"), (top + 12).cast("double").alias("bottom"), F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), (F.lit(8.0) + F.col("l_linenumber")).alias("font_size"))


_BOX = "x AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS ord, lower(l_returnflag || ' ' || l_linestatus || ' ' || l_linenumber) AS txt, l_quantity * 10 AS l, l_quantity * 10 + 8 AS r, floor(l_extendedprice / 100) * 20 AS t, floor(l_extendedprice / 100) * 20 + 12 AS b FROM lineitem), e AS (SELECT page, min(l) lo, max(r) hi FROM x GROUP BY page)"
_PROFILE = f"{_BOX}, g AS (SELECT page, lo, hi, unnest(range(0, CAST(greatest(1, ceil((hi - lo) / 4)) AS BIGINT))) AS bin FROM e), p AS (SELECT g.page, g.bin, CAST(count(x.page) AS DOUBLE) AS weight FROM g LEFT JOIN x ON x.page = g.page AND g.bin >= floor((x.l - g.lo) / 4) AND g.bin < ceil((x.r - g.lo) / 4) GROUP BY 1, 2)"
#: Tops are 20 apart, so a line is the boxes of one top.
LINES = f"{_BOX}, ln AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY page ORDER BY t) - 1 AS INTEGER) AS line FROM x)"


@query(f"WITH {_PROFILE} SELECT * FROM p")
def layout_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.projection_profile(_boxes(spark, sf_dir), "x", 4.0)


@query(f"""WITH {_PROFILE}, k AS (SELECT page, bin, bin - row_number() OVER (PARTITION BY page ORDER BY bin) k FROM p WHERE weight <= 8), v AS (SELECT page, min(bin) AS start, max(bin) + 1 AS "end" FROM k GROUP BY page, k)
SELECT page, start, "end", "end" - start AS width, (start + "end") // 2 AS center, CAST(row_number() OVER (PARTITION BY page ORDER BY "end" - start DESC, start) AS INTEGER) AS rank FROM v""")
def layout_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.find_valleys(L.projection_profile(_boxes(spark, sf_dir), "x", 4.0), 8.0)


@query(f"WITH {LINES} SELECT page, line, CAST(row_number() OVER (PARTITION BY page, line ORDER BY l, ord) - 1 AS INTEGER) AS position, ord FROM ln")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.group_into_lines(_boxes(spark, sf_dir)).select("page", "line", "position", "ord")


@query(f"""WITH {LINES}, g AS (SELECT *, CASE WHEN l - max(r) OVER (PARTITION BY page, t ORDER BY l, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 10 THEN 1 ELSE 0 END c FROM ln), h AS (SELECT *, sum(c) OVER (PARTITION BY page, t ORDER BY l, ord) k FROM g)
SELECT page, ord, CAST(dense_rank() OVER (PARTITION BY page ORDER BY t, k) - 1 AS INTEGER) AS region FROM h""")
def layout_xy_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.xy_cut(_boxes(spark, sf_dir))


@query(f"""WITH {_BOX}, v AS (SELECT page, min(t) lo, max(b) hi FROM x GROUP BY page), z AS (SELECT page, ord, txt, CASE WHEN (t + b) / 2 < lo + (hi - lo) * 0.1::DOUBLE THEN 'header' WHEN (t + b) / 2 > hi - (hi - lo) * 0.1::DOUBLE THEN 'footer' END AS zone FROM x JOIN v USING (page) WHERE hi > lo),
f AS (SELECT zone, txt FROM z WHERE zone IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page) >= greatest(2, floor((SELECT count(*) FROM v) * 0.5))) SELECT page, ord, zone FROM z JOIN f USING (zone, txt)""")
def layout_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.headers_footers(_boxes(spark, sf_dir))


@query("""WITH s AS (SELECT 8.0::DOUBLE + l_linenumber AS size, count(*) AS blocks FROM lineitem GROUP BY 1), c AS (SELECT a.size a, b.size b, d.size d FROM s a, s b, s d WHERE a.size < b.size AND b.size < d.size AND d.size < (SELECT max(size) FROM s)),
l AS (SELECT a, b, d, size, blocks, CASE WHEN size <= a THEN 0 WHEN size <= b THEN 1 WHEN size <= d THEN 2 ELSE 3 END k FROM c, s), v AS (SELECT a, b, d, sum(v) v FROM (SELECT a, b, d, k, sum(blocks * size * size) - pow(sum(blocks * size), 2) / sum(blocks) v FROM l GROUP BY ALL) GROUP BY ALL),
w AS (SELECT a, b, d FROM v ORDER BY round(v, 6), a, b, d LIMIT 1) SELECT size, blocks, ['footnote', 'body', 'subheading', 'heading'][k + 1] AS role FROM l SEMI JOIN w USING (a, b, d)""")
def layout_font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sizes in four natural classes; the SQL tries every way to cut."""
    return L.classify_font_sizes(_boxes(spark, sf_dir).withColumn("doc", F.lit(1)), "doc").drop("doc")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(spark, sf_dir, S.tumbling, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start FROM events) GROUP BY start")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(spark, sf_dir, S.sliding, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END b FROM events)) GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(spark, sf_dir, S.sessions, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(spark, sf_dir, S.running_totals, "update")

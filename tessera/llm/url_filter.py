"""URL filter with a weighted vocabulary, matched by an Aho-Corasick automaton.

The lower-cased URL is scanned once for all terms. A hit counts only where it is bounded on both sides by the end of
the URL or by a character other than a-z and 0-9. One strict term rejects; so do `MIN_SOFT` distinct soft terms. A
term's weight enters `score`, the sum over the distinct terms hit.

The lists here are a small default; a deployment brings its own as a table of (term, weight, strict), see `vocabulary`. The
automaton travels with the task, so a vocabulary of over `MOST_TERMS` terms is refused.

Defined cases: a null or empty URL has no hits, score 0 and stays; a term hit many times counts once; a URL of any length is
scanned whole; every row has one result row, repeated rows and null ids too; an empty table gives an empty result;
other columns are never read, those called as a result are replaced. A projection: no shuffle.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRICT = {t: 10 for t in ("adult", "bdsm", "casino", "cialis", "escort", "hardcore", "hentai", "malware", "nude", "phishing", "porn", "sex", "spam", "viagra", "warez", "xxx")}
SOFT = {"ads": 1, "affiliate": 1, "bet": 1, "bonus": 1, "buy": 1, "cam": 1, "cheap": 2, "click": 1, "coupon": 1, "dating": 2, "deal": 1, "farm": 1, "free": 1, "hot": 1, "loan": 2, "pill": 2, "pills": 2, "poker": 2, "popup": 1, "promo": 1, "slots": 2, "track": 1, "tracker": 1, "win": 1}
MIN_SOFT = 2
MOST_TERMS = 1_000_000
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def vocabulary(terms: DataFrame, most: int | None = None) -> tuple[dict[str, int], dict[str, int]]:
    """(strict, soft) of a table (term, weight, strict): terms are folded, null and empty ones dropped, of a repeated term the largest
    weight stays, a term that is strict once is strict."""
    most = MOST_TERMS if most is None else most
    t = F.lower(F.trim("term"))
    kept = terms.select(t.alias("t"), F.coalesce("weight", F.lit(1)).cast("int").alias("w"), F.coalesce("strict", F.lit(False)).alias("s")).where("t <> ''")
    rows = kept.groupBy("t").agg(F.max("w").alias("w"), F.max("s").alias("s")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} terms")
    return {r.t: r.w for r in rows if r.s}, {r.t: r.w for r in rows if not r.s}


def automaton(terms: dict[str, int]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t.lower(), t.lower())
    a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, url: str) -> set[str]:
    """Distinct bounded terms of a lower-cased URL."""
    found, last = set(), len(url) - 1
    for end, term in a.iter(url):
        begin = end - len(term)
        if (begin < 0 or url[begin] not in _INNER) and (end == last or url[end + 1] not in _INNER):
            found.add(term)
    return found


def url_filter(df: DataFrame, url: str = "url", strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """Adds n_strict, n_soft, score, terms (sorted, joined by commas) and rejected."""

    @F.pandas_udf("struct<n_strict:int,n_soft:int,score:int,terms:string>")
    def scan(urls: pd.Series) -> pd.DataFrame:
        a, rows = automaton(strict | soft), []
        for u in urls:
            h = hits(a, u) if u else ()
            rows.append((sum(t in strict for t in h), sum(t in soft for t in h), sum(strict.get(t, 0) + soft.get(t, 0) for t in h), ",".join(sorted(h))))
        return pd.DataFrame(rows, columns=["n_strict", "n_soft", "score", "terms"])

    made = ("n_strict", "n_soft", "score", "terms", "rejected")
    kept = [df[f"`{c}`"] for c in df.columns if c not in made]
    got = df.select(*kept, scan(F.lower(df[url])).alias("__hit"))
    n = F.col("__hit.n_strict"), F.col("__hit.n_soft")
    return got.select("*", "__hit.*", ((n[0] >= 1) | (n[1] >= min_soft)).alias("rejected")).drop("__hit")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def sql() -> str:
    terms = ", ".join(f"('{t}', {int(t in STRICT)}, {STRICT.get(t, 0) + SOFT.get(t, 0)})" for t in STRICT | SOFT)
    return f"""
WITH vocab(term, strict, weight) AS (VALUES {terms}),
hit AS (SELECT p.page_id, v.* FROM pages p JOIN vocab v
        ON regexp_matches(lower(p.url), '(^|[^a-z0-9])' || v.term || '([^a-z0-9]|$)')),
got AS (SELECT page_id, sum(strict) ns, count(*) - sum(strict) nf, sum(weight) w, string_agg(term, ',' ORDER BY term) t FROM hit GROUP BY page_id)
SELECT p.page_id, p.url, CAST(coalesce(ns, 0) AS INTEGER) AS n_strict, CAST(coalesce(nf, 0) AS INTEGER) AS n_soft,
       CAST(coalesce(w, 0) AS INTEGER) AS score, coalesce(t, '') AS terms, coalesce(ns, 0) >= 1 OR coalesce(nf, 0) >= {MIN_SOFT} AS rejected
FROM pages p LEFT JOIN got USING (page_id)"""


QUERIES = {"op8_url_terms": query}
SQL = {"op8_url_terms": sql()}

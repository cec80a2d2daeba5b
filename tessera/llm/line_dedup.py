"""Line dedup by content-defined chunks of lines.

Lines are hashed (the first 28 bits of their MD5); a rolling hash over the last three line hashes ends a chunk where it
is 0 modulo `MEAN_LINES`. The bounds depend on nearby lines only, so after an inserted or deleted line they fall into
step again and shared passages give the same chunks at any offset. A chunk of at least two lines that aren't blank,
which the corpus holds elsewhere, is removed everywhere but at its first occurrence (smallest doc_id, then first in
the text).

The digest of a chunk finds candidates, bytes decide: digests of all chunks are counted first, 24 bytes a chunk; only chunks
whose digest stands in two documents or more send their text, and texts of a digest are compared after partial
aggregation, so that a passage in millions of documents is one row a task before the shuffle. Should two different
texts share a digest, none of them is removed. Up to `BROADCAST` shared digests go to the tasks as a sorted table (24 bytes
each), and no document is moved; beyond it texts and documents are joined with them by shuffles. Both ways give the same.

Defined cases: null texts stay null, empty ones empty; a text of one line never changes; chunks of null doc_id count as
last and are removed if any document with an id has them; rows that share a doc_id hold their chunks in common (each
keeps them, if no smaller id has them); the order and bytes of the other lines never change; a column called
`removed_lines` is replaced, others pass through.

`repeated_lines` does without chunks, which leave out most short passages: it removes every run of at least two lines that
aren't blank which stands earlier in the corpus, smallest (doc_id, text hash, line) first. Two successive such lines and
the blank ones between them are a seed; a run is repeated where all its seeds are, so marking each later place of a
seed finds whole runs, whatever their length and offset. Seeds are narrow rows of a 256-bit BLAKE2b hash, which stands
for the bytes, and their place; texts move once, by id, to meet their removals. The first place of every line stays, so
of a line that follows itself k times one does; blank lines around a removed run stay; rows with equal id and text
keep their runs in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize, release, small_batches

MEAN_LINES = 4
MIN_LINES = 2
#: Shared digests that are sent to every task.
BROADCAST = 1_000_000
_LAST = (1 << 63) - 1


def chunks(text: str, mean: int = MEAN_LINES) -> list[tuple[int, list[str]]]:
    """(first line's number, lines) of each chunk."""
    lines = text.split("\n")
    out, begin, a, b = [], 0, 0, 0
    for i, line in enumerate(lines):
        h = int(md5(line.encode(), usedforsecurity=False).hexdigest()[:7], 16)
        if (h + 31 * a + 961 * b) % mean == 0:
            out.append((begin, lines[begin : i + 1]))
            begin = i + 1
        a, b = h, a
    if begin < len(lines):
        out.append((begin, lines[begin:]))
    return out


def _multi(lines: list[str]) -> bool:
    return len(lines) >= MIN_LINES and sum(1 for x in lines if x and not x.isspace()) >= MIN_LINES


def _digest(chunk: str) -> bytes:
    return md5(chunk.encode(), usedforsecurity=False).digest()


class Shared:
    """Digests that several documents hold, sorted, and the smallest id of each."""

    def __init__(self, digests: list[bytes], first: np.ndarray) -> None:
        keys = np.array(digests, "S16")
        order = np.argsort(keys)
        self.keys, self.first = keys[order], first[order]

    def first_of(self, digest: bytes) -> int | None:
        k = int(np.searchsorted(self.keys, np.bytes_(digest)))
        return int(self.first[k]) if k < len(self.keys) and self.keys[k] == digest.rstrip(b"\0") else None


def _emit(with_text: bool, mean: int, shared: Broadcast | None = None):  # noqa: ANN202
    """(id, digest, text) of each chunk of a document, once; with `shared` of its chunks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, digests, texts = [], [], []
                for doc, text in zip(batch.column(0).slice(at, 512).to_pylist(), batch.column(1).slice(at, 512).to_pylist(), strict=True):
                    seen = set()
                    for _, lines in chunks(text or "", mean):
                        if _multi(lines) and (d := _digest(c := "\n".join(lines))) not in seen:
                            seen.add(d)
                            if shared is not None and shared.value.first_of(d) is None:
                                continue
                            ids.append(doc)
                            digests.append(d)
                            if with_text:
                                texts.append(c)
                cols = [pa.array(ids, pa.int64()), pa.array(digests, pa.binary())] + ([pa.array(texts, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(cols, names=["id", "digest", "chunk"][: len(cols)])

    return run


def _without(text: str, mean: int, gone: Callable[[bytes], bool]) -> tuple[str, int]:
    """The text without chunks that are gone or stand in it before, and how many lines went."""
    seen, kept, n = set(), [], 0
    for _, lines in chunks(text, mean):
        if _multi(lines):
            d = _digest("\n".join(lines))
            if d in seen or gone(d):
                n += len(lines)
                continue
            seen.add(d)
        kept += lines
    return ("\n".join(kept) if n else text), n


def _cut(mean: int, shared: Broadcast | None = None):  # noqa: ANN202
    """Texts without their removed chunks: those listed in `__gone`, or those of `shared` that a smaller id has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, g = batch.schema.get_field_index("text"), batch.schema.get_field_index("__gone")
            texts, counts = [], []
            for text, mark in zip(batch.column(k).to_pylist(), batch.column(g).to_pylist(), strict=True):
                if shared is None:
                    held = set(mark or ())
                    gone = held.__contains__
                else:
                    gone = lambda d, mark=mark: (f := shared.value.first_of(d)) is not None and mark > f
                text, n = (None, 0) if text is None else _without(text, mean, gone)
                texts.append(text)
                counts.append(n)
            cols = [pa.array(texts, pa.string()) if i == k else pa.array(counts, pa.int32()) if i == g else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=[n if n != "__gone" else "removed_lines" for n in batch.schema.names])

    return run


def _sent(shared: DataFrame) -> Broadcast:
    """(digest, first) rows, counted before, as a table for every task."""
    rows = shared.select("digest", "first").toArrow()
    return shared.sparkSession.sparkContext.broadcast(Shared(rows.column("digest").to_pylist(), rows.column("first").to_numpy()))


def line_dedup(docs: DataFrame, mean: int = MEAN_LINES) -> DataFrame:
    """The documents with repeated multi-line chunks cut out, and removed_lines."""
    docs = docs.drop("removed_lines")
    small_batches(docs.sparkSession)
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST))
    slim = docs.select(key.alias("id"), "text")
    digests = slim.mapInArrow(_emit(False, mean), "id long, digest binary")
    often = materialize(digests.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "digests")
    few = often.count() <= BROADCAST
    if few:
        texts = slim.mapInArrow(_emit(True, mean, _sent(often)), "id long, digest binary, chunk string")
    else:
        texts = slim.mapInArrow(_emit(True, mean), "id long, digest binary, chunk string").join(often.select("digest"), "digest")
    # one text a digest: bytes are equal; repeated rows of an id count as in `often`
    held = texts.groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("n"))
    same = held.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts = 1").select("digest")
    shared = materialize(often.join(same, "digest").select("digest", "first"), "shared")
    release(often)
    fields = [f for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", removed_lines int"
    if few:
        return docs.withColumn("__gone", key).mapInArrow(_cut(mean, _sent(shared)), schema)
    gone = digests.join(shared, "digest").where("id > first").groupBy("id").agg(F.collect_set("digest").alias("__gone"))
    met = docs.withColumn("__id", key).join(gone.withColumnRenamed("id", "__id"), "__id", "left").drop("__id")
    return met.mapInArrow(_cut(mean), schema)


def seeds(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, bytes) of each two successive lines that aren't blank, with the blank ones between."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    for i, j in zip(full, full[1:]):
        yield i, j, "\n".join(lines[i : j + 1])


def _row(text: str | None) -> int:
    return int.from_bytes(blake2b((text or "").encode(), digest_size=8).digest(), "big", signed=True)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            ids, rows, lines, digests = [], [], [], []
            for doc, text in zip(batch.column(0).slice(at, 512).to_pylist(), batch.column(1).slice(at, 512).to_pylist(), strict=True):
                row = _row(text)
                for i, _, seed in seeds(text or ""):
                    ids.append(doc)
                    rows.append(row)
                    lines.append(i)
                    digests.append(blake2b(seed.encode(), digest_size=32).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(lines, pa.int64()), pa.array(digests, pa.binary())], names=["id", "row", "line", "digest"])


def _key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], names=[*batch.schema.names, "__row"])


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, g = batch.schema.get_field_index("text"), batch.schema.get_field_index("__gone")
        texts, counts = [], []
        for text, gone in zip(batch.column(k).to_pylist(), batch.column(g).to_pylist(), strict=True):
            cut = set()
            if gone:
                lines, gone = text.split("\n"), set(gone)
                for i, j, _ in seeds(text):
                    if i in gone:
                        cut.update(range(i, j + 1))
                text = "\n".join(x for i, x in enumerate(lines) if i not in cut)
            texts.append(text)
            counts.append(len(cut))
        cols = [pa.array(texts, pa.string()) if i == k else pa.array(counts, pa.int32()) if i == g else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(cols, names=[n if n != "__gone" else "removed_lines" for n in batch.schema.names])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without the runs of two lines or more that the corpus holds earlier, and removed_lines."""
    docs = docs.drop("removed_lines")
    key = F.coalesce(docs["doc_id"], F.lit(_LAST))
    places = docs.select(key.alias("id"), "text").mapInArrow(_places, "id long, row long, line long, digest binary")
    here = F.struct("id", "row", "line")
    shared = places.groupBy("digest").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    gone = places.join(shared, "digest").where(here > F.col("first")).groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("line").alias("__gone"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    keyed = docs.withColumn("__id", key).mapInArrow(_key, f"{fields}, __id long, __row long")
    return keyed.join(gone, ["__id", "__row"], "left").drop("__id", "__row").mapInArrow(_cut_lines, f"{fields}, removed_lines int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def query_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL_TEXT = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents),
h AS (SELECT *, CAST('0x' || left(md5(line), 7) AS BIGINT) h FROM l),
r AS (SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % {MEAN_LINES} = 0 AS cut FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
c AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) chunk, count(*) n, count(*) FILTER (WHERE trim(line) <> '') full_lines FROM k GROUP BY doc_id, k),
f AS (SELECT *, n >= {MIN_LINES} AND full_lines >= {MIN_LINES} AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS gone FROM c)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text, CAST(coalesce(x.m, 0) AS INTEGER) AS removed_lines
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS text, sum(n) FILTER (WHERE gone) AS m FROM f GROUP BY doc_id) x USING (doc_id)"""

QUERIES = {"op7_line_chunks": query, "op7_repeated_lines": query_repeated}
SQL_REPEATED = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) ls FROM documents), l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) i FROM d), f AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) j FROM l WHERE trim(ls[i]) <> ''),
s AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY array_to_string(ls[i:j], chr(10)) ORDER BY doc_id, i) > 1 AS gone FROM f WHERE j IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) i FROM s WHERE gone), k AS (SELECT l.doc_id, string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(g.i) AS m FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.m, 0) AS INTEGER) AS removed_lines FROM d LEFT JOIN k USING (doc_id)"""

SQL = {"op7_line_chunks": SQL_TEXT, "op7_repeated_lines": SQL_REPEATED}

"""Suffix-array dedup: passages of at least `WORDS` words that two documents or more share, by the collection BWT.

The suffix order of a collection is built column by column (see bwt.py): one symbol a string a round. A round costs the
collection, so strings must be short and collections must be independent; both come from content-defined anchors:

1. Every run of WORDS words has one anchor, the run of `ANCHOR` words in it with the smallest hash (the first of equal
   ones). Equal runs have equal anchors at the same place, so runs under different anchors are never equal. A document
   becomes overlapping strings, one an anchor, that hold all runs of WORDS words with that anchor: at most
   2 x WORDS - ANCHOR words, however long the document is.
2. Anchors that only one document has can't be in a shared passage; with them nearly all of the corpus is out. What was
   sent so far are hashes and places.
3. Equal strings under an anchor are one string with the ids of its documents. Anchors with one string only need no order.
4. The words of the other strings are fetched, once for equal ones. All strings of an anchor meet in one task, which
   builds the BWT and common prefixes of its collection (of many anchors at once: runs of different anchors differ).
   Suffixes with a common prefix of WORDS words are the same passage; where two documents hold it, it is repeated.
5. Repeated runs that touch or overlap become one span of a document. `repeats` reports the spans, `remove_repeats` cuts
   out all but the first occurrence of each run (smallest id).

A hot anchor (boilerplate in many different surroundings) would bring all its strings into one task. Anchors with more
than `HOT` strings are split: each of their runs is keyed by the anchor and the next smallest hash in the run, which
again is the same for equal runs, and so on for up to `LEVELS` hashes. That costs a pass over the texts a level, and only
where there is such an anchor; strings of a key beyond that are ordered in sequential files, see bwt.py.

Anchors are 64-bit hashes, strings of one anchor are told apart by another 64 bits. The alphabet of a collection is made
of the words' bytes, so the order compares words themselves.

Defined cases: null and empty texts and those under WORDS words have no spans; a null doc_id takes no part (and is left as
it is by `remove_repeats`); very long texts are any number of short strings; repeats inside one document alone don't
count; rows that share a doc_id are one document: they aren't repeats of each other, and the spans of each are reported
under the id; equal rows give equal spans, once; an empty table gives an empty result; other columns are never read,
and pass through `remove_repeats`, but for `removed_words`, which is replaced. Words are compared in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bwt
from tessera.llm import textkit as tk
from tessera.session import materialize, release, shared_dir, small_batches

WORDS = 50
ANCHOR = 10
#: Strings of a collection that are worth a build; an anchor with more is built by itself.
BATCH = 2000
#: Strings of an anchor from which it is split, and how often that is done.
HOT, LEVELS = 200_000, 3
_DIGIT = 60_000
_WORD = re.compile(tk.WORD)


def _split(key: np.ndarray, start: np.ndarray, best: np.ndarray, spread: int, hot: list[np.ndarray]) -> np.ndarray:
    """Keys of runs, those of hot ones mixed with the next smallest hash of the run."""
    key = key.copy()
    floor = key.copy()
    for level in hot:
        rows = np.flatnonzero(np.isin(key, level))
        for at in range(0, len(rows), 1 << 14):
            r = rows[at : at + (1 << 14)]
            window = best[start[r][:, None] + np.arange(spread)]
            window = np.where(window > floor[r][:, None], window, np.iinfo(np.uint64).max)
            floor[r] = window.min(axis=1)
            key[r] = tk.mix(key[r] * np.uint64(31) + floor[r])
    return key


def strings(w: tk.Words, least: int, anchor: int, hot: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """anchor hash, hash of the string, document of the batch, first word in it, words: one row a string."""
    none = np.zeros(0, np.int64)
    n = len(w.hash)
    if n < least:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    spread = least - anchor + 1
    all_at = np.arange(n - anchor + 1)
    best = tk.range_hashes(w.hash, all_at, all_at + anchor)  # runs over a text's end never count: starts are chosen below
    value, where = best, all_at
    width = 1
    while 2 * width <= spread:
        left, right = slice(0, len(value) - width), slice(width, None)
        take = value[left] <= value[right]
        value, where = np.where(take, value[left], value[right]), np.where(take, where[left], where[right])
        width *= 2
    if width < spread:
        step = spread - width
        a, b = slice(0, len(value) - step), slice(step, None)
        where = np.where(value[a] <= value[b], where[a], where[b])
    left = np.repeat(w.offsets[1:], w.counts) - np.arange(n)
    start = np.flatnonzero(left[: len(where)] >= least)
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    at = where[start]
    doc = np.searchsorted(w.offsets, start, "right") - 1
    key = _split(best[at], start, best, spread, hot or [])
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(start) != 1) | (key[1:] != key[:-1])
    head = np.flatnonzero(new)
    lo, hi = start[head], start[np.append(head[1:], len(start)) - 1] + least
    whole = tk.range_hashes(w.hash, lo, hi) + (at[head] - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return key[head], whole, doc[head], lo - w.offsets[doc[head]], hi - lo


def _places(least: int, anchor: int, hot: list[np.ndarray]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                a, s, doc, lo, n = strings(tk.words(part.column("text")), least, anchor, hot)
                yield pa.RecordBatch.from_arrays([tk.signed(a), tk.signed(s), part.column("doc_id").take(pa.array(doc)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int16))], names=["anchor", "string", "doc_id", "lo", "n"])

    return run


def _fetch(least: int, anchor: int, hot: list[np.ndarray]):  # noqa: ANN202
    """Words of the strings that are asked of a document; a row of the same id with another text gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                w = tk.words(part.column("text"))
                a, s, doc, lo, n = strings(w, least, anchor, hot)
                at = {(int(d), int(x), int(y)): i for i, (d, x, y) in enumerate(zip(doc, lo, s.view(np.int64), strict=True))}
                data, out = w.data.tobytes(), ([], [], [], [], [])
                for d, asked in enumerate(part.column("asked").to_pylist()):
                    for x in asked:
                        i = at.get((d, x["lo"], x["string"]))
                        if i is not None:
                            first = w.offsets[d] + lo[i]
                            text = data[w.start[first] : w.end[first + n[i] - 1]]
                            for c, v in zip(out, (x["anchor"], x["string"], x["least"], x["most"], text), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=["anchor", "string", "least", "most", "words"])

    return run


def alphabet_of(w: tk.Words) -> tuple[int, np.ndarray]:
    """Number of different words, by their bytes, and which one each is."""
    data = np.ascontiguousarray(w.data[~tk._SPACE[w.data]])
    ends = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(w.end - w.start, out=ends[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)


def repeated_starts(texts: pa.Array, first: np.ndarray, last: np.ndarray, least: int, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start word, whether an earlier document than all of the string's has it) of every run of `least` words that strings of different documents share.

    texts: the strings; first, last: smallest and largest id of the documents that hold each.
    """
    w = tk.words(texts, lower=False)
    known, code = alphabet_of(w)
    digits = 1 if known <= 65_534 else 2
    if digits == 2:  # a word is two symbols from disjoint ranges
        high = known // _DIGIT + 1
        symbols = np.empty(2 * len(code), np.uint16)
        symbols[::2], symbols[1::2] = code // _DIGIT + 1, code % _DIGIT + high + 1
        alphabet = high + _DIGIT
    else:
        symbols, alphabet = (code + 1).astype(np.uint16), known
    files = bwt.build(symbols, w.offsets * digits, alphabet, least * digits, folder)
    files[0].drop()
    out_s, out_a, out_o = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for names, run in bwt.classes(files[1], files[2], least * digits):
        if not len(names):
            continue
        s, length = names >> 20, names & ((1 << 20) - 1)
        head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        times = np.diff(np.append(head, len(s)))
        owner = np.minimum.reduceat(first[s], head)
        shared = owner < np.maximum.reduceat(last[s], head)
        keep = np.repeat(shared, times) & (length % digits == 0)  # at a word's first symbol
        out_s.append(s[keep])
        out_o.append((np.repeat(owner, times) < first[s])[keep])
        out_a.append((w.counts[s] * digits - length)[keep] // digits)
    for f in files[1:]:
        f.drop()
    return np.concatenate(out_s), np.concatenate(out_a), np.concatenate(out_o)


_ORDERED = "anchor long, string long, least long, `from` int, `to` int, older boolean"


def _order(least: int, folder: str):  # noqa: ANN202
    def solve(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(batches).combine_chunks()
        first, last = (batch.column(c).to_numpy() for c in ("least", "most"))
        s, at, older = repeated_starts(batch.column("words").combine_chunks().cast(pa.large_binary()).cast(pa.large_string()), first, last, least, folder)
        order = np.lexsort((at, older, s))
        s, at, older = s[order], at[order], older[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (older[1:] != older[:-1]) | (np.diff(at) > least)
        head = np.flatnonzero(new)
        lo, hi = at[head], (at[np.append(head[1:], len(at)) - 1] + least) if len(head) else at[head]
        rows = pa.array(s[head])
        cols = [*(batch.column(c).combine_chunks().take(rows) for c in ("anchor", "string", "least")), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(older[head])]
        return pa.RecordBatch.from_arrays(cols, names=["anchor", "string", "least", "from", "to", "older"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors, at = batch.column("anchor").to_numpy(), 0
            changes = np.flatnonzero(np.concatenate([[anchors[0] != last], anchors[1:] != anchors[:-1]]))
            for to in changes:  # a collection ends with an anchor
                if rows + to - at >= BATCH:
                    yield solve([*held, batch.slice(at, to - at)])
                    held, rows, at = [], 0, int(to)
            held.append(batch.slice(at))
            rows, last = rows + batch.num_rows - at, anchors[-1]
        if held:
            yield solve(held)

    return run


def _found(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    """doc_id, s, e (words), first (whether no smaller id has it) of repeated pieces; they overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    hot: list[np.ndarray] = []
    while True:
        places = materialize(rows.mapInArrow(_places(least, anchor, list(hot)), "anchor long, string long, doc_id long, lo int, n short"), "places")
        shared = places.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
        some = materialize(places.join(shared, "anchor"), "shared")
        release(places)
        distinct = materialize(
            some.groupBy("anchor", "string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min_by(F.struct("doc_id", "lo"), "doc_id").alias("at"), F.first("n").alias("n")), "strings"
        )
        counted = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("strings"))
        big = counted.where(F.col("strings") > HOT).select("anchor").toPandas()["anchor"].to_numpy(np.int64) if len(hot) < LEVELS else []
        if not len(big):
            break
        hot.append(np.sort(big.view(np.uint64)))
        release(some, distinct)
    kinds = counted.where("strings > 1").select("anchor")
    asked = distinct.join(kinds, "anchor").groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "string", F.col("at.lo").alias("lo"), "least", "most")).alias("asked"))
    fetched = rows.join(asked, "doc_id").mapInArrow(_fetch(least, anchor, hot), "anchor long, string long, least long, most long, words binary").dropDuplicates(["anchor", "string"])
    ordered = fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_order(least, shared_dir(spark) + "/bwt"), _ORDERED)
    # a string that several documents hold is repeated as a whole
    whole = distinct.where("least < most").select("anchor", "string", "least", F.lit(0).alias("from"), F.col("n").cast("int").alias("to"), F.lit(False).alias("older"))
    return some.join(ordered.union(whole), ["anchor", "string"]).select("doc_id", (F.col("lo") + F.col("from")).alias("s"), (F.col("lo") + F.col("to")).alias("e"), (~F.col("older") & (F.col("doc_id") == F.col("least"))).alias("first"))


def _spans(pieces: DataFrame) -> DataFrame:
    """doc_id, from_word, to_word of what the pieces cover together."""
    by = Window.partitionBy("doc_id").orderBy("s", "e")
    island = pieces.select("doc_id", "s", "e").distinct().withColumn("top", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    island = island.withColumn("k", F.sum(F.when(F.col("s") <= F.col("top"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "k").agg(F.min("s").cast("long").alias("from_word"), F.max("e").cast("long").alias("to_word")).drop("k")


def repeats(docs: DataFrame, least: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, from_word, to_word (exclusive), n_words of every maximal span that other documents share."""
    return _spans(_found(docs, least, anchor)).select("doc_id", "from_word", "to_word", (F.col("to_word") - F.col("from_word")).alias("n_words"))


def _cut(names: list[str]):  # noqa: ANN202
    """Texts without the words of their spans, each cut up to the word after it; and how many words went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                texts, spans = part.column("text").to_pylist(), part.column("__spans").to_pylist()
                counts = []
                for d, asked in enumerate(spans):
                    gone = 0
                    # places are those of the lower-cased text: cut the text itself word by word
                    if asked and texts[d] is not None:
                        at = [(m.start(), m.end()) for m in _WORD.finditer(texts[d])]
                        kept, done = [], 0
                        for lo, hi in sorted((x["from_word"], x["to_word"]) for x in asked):
                            if hi <= len(at):
                                kept.append(texts[d][done : at[lo][0]])
                                done = at[hi][0] if hi < len(at) else at[hi - 1][1]
                                gone += hi - lo
                        texts[d] = "".join(kept) + texts[d][done:]
                    counts.append(gone)
                k, g = names.index("text"), part.schema.get_field_index("__spans")
                cols = [pa.array(texts, pa.string()) if i == k else c for i, c in enumerate(part.columns) if i != g]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*names, "removed_words"])

    return run


def remove_repeats(docs: DataFrame, least: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """The documents without runs of `least` words that a document with a smaller id holds, and removed_words."""
    docs = docs.drop("removed_words")
    gone = _spans(_found(docs, least, anchor).where("NOT first"))
    asked = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("from_word", "to_word")).alias("__spans"))
    met = docs.join(asked, docs["doc_id"].cast("long") == asked["__id"], "left").drop("__id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return met.mapInArrow(_cut(docs.columns), f"{fields}, removed_words long")


def query_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_TEXT = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\x0B]+') ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WORDS - 1}], ' ')) h FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WORDS - 2})) AS i)),
r AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, i FROM g SEMI JOIN r USING (h)),
k AS (SELECT *, sum(CASE WHEN i - p <= {WORDS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM s))
SELECT doc_id, min(i) - 1 AS from_word, max(i) - 1 + {WORDS} AS to_word, max(i) - min(i) + {WORDS} AS n_words FROM k GROUP BY doc_id, k"""

QUERIES = {"op4_suffix_repeats": query, "op4_remove_repeats": query_removed}
_WHITE = r"[ \t\n\r\f\x0B]"
SQL_REMOVED = f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{tk.WORD}') ws, regexp_extract_all(text, '{tk.WORD}{_WHITE}*') ps FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WORDS - 1}], ' ')) h FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WORDS - 2})) AS i)),
o AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) m FROM g) WHERE m < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WORDS})) i FROM o), p AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) i, unnest(ps) piece, len(ps) n FROM w),
k AS (SELECT p.doc_id, string_agg(CASE WHEN x.i IS NULL THEN piece WHEN p.i = n THEN regexp_extract(piece, '{_WHITE}*$') ELSE '' END, '' ORDER BY p.i) AS t, count(x.i) AS m FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(k.m, 0) = 0 THEN d.text ELSE regexp_extract(d.text, '^{_WHITE}*') || k.t END AS text, d.lang, d.source, d.n_chars, coalesce(k.m, 0) AS removed_words FROM documents d LEFT JOIN k USING (doc_id)"""
SQL = {"op4_suffix_repeats": SQL_TEXT, "op4_remove_repeats": SQL_REMOVED}

"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Seeds are all runs of `SEED` words of the benchmark items, common ones too, so that a copy is found however many
documents hold it. One pass looks every run of words of every document up among the seeds. A hit places the item
beside the document; the stretch there, widened by a third of the item, overlapping stretches of an item as one, is
aligned with the whole item (match 2, mismatch -1, gap -1). The score is the share of the best possible, 2 x words of
the item; from `SCORE` on the document holds a copy, exact, edited or paraphrased in places. Stretches that share too
few words with the item to reach that in any order, which is what most hits of common seeds are, are not aligned.

Items and seeds are broadcast in slabs of at most `SLAB` words of benchmark text, or of one item id's, one pass over the
corpus a slab, so neither grows with the benchmark beyond that; nothing is shuffled.

Defined cases: null and empty texts and items match nothing; an item of fewer than `SEED` words is its own seed, so it
is found where it stands unchanged; equal rows give equal rows; items with equal ids are told apart by their text and
reported by id (once, with the best score); a null doc_id or item_id takes no part in the report, but a null doc_id
is filtered like any other; texts of any length are searched whole; an empty benchmark contaminates nothing, an empty
table gives an empty result; other columns are never read, and pass through `reject_contaminated` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.session import small_batches

SEED = 4
SCORE = 0.5
SLAB = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_CELLS = 1 << 21
_PAIRS = 1 << 18
_WORDS = 1 << 20


class Slab:
    """Benchmark items as word hashes, and their seeds sorted by hash with the places where each occurs."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        w = tk.words(pa.array(texts, pa.string()))
        self.ids, self.words, self.offsets = np.array(ids, np.int64), w.hash, w.offsets
        owner, runs = np.repeat(np.arange(len(ids)), w.counts), []
        for n in range(1, SEED + 1):
            grams, at = tk.ngrams(w, n)
            if n < SEED:  # shorter items as a whole
                own = w.counts[owner[at]] == n
                grams, at = grams[own], at[own]
            runs.append((grams, at))
        #: The lengths of runs that some item has a seed of.
        self.lengths = [n for n, (g, _) in enumerate(runs, 1) if len(g)]
        grams, at = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(grams, kind="stable")
        item = owner[at[order]]
        self.gram, self.item, self.place = grams[order], item, at[order] - w.offsets[item]
        self.keys, self.first = np.unique(self.gram, return_index=True)
        # words of each item, and how often it has them
        self.vocabulary, word = np.unique(self.words, return_inverse=True)
        self.held, self.times = np.unique(np.repeat(np.arange(len(ids)), w.counts) * len(self.vocabulary) + word, return_counts=True)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known runs, and which key each is."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[k] == grams)
        return at, k[at]

    def most_matches(self, w: tk.Words, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many words of each item its stretch has, whatever their order: no alignment matches more."""
        most, size = np.zeros(len(item), np.int64), hi - lo
        upto = np.cumsum(size)
        at = 0
        while at < len(item):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _WORDS, "right")))
            row = np.repeat(np.arange(at, to), size[at:to])
            h = w.hash[np.arange(len(row)) - np.repeat(upto[at:to] - size[at:to] - lo[at:to] - (upto[at - 1] if at else 0), size[at:to])]
            known = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            same = np.flatnonzero(self.vocabulary[known] == h)
            row, word = row[same], item[row[same]] * len(self.vocabulary) + known[same]
            held = np.minimum(np.searchsorted(self.held, word), len(self.held) - 1)
            same = np.flatnonzero(self.held[held] == word)
            pair, n = np.unique(row[same] * len(self.held) + held[same], return_counts=True)
            np.add.at(most, pair // len(self.held), np.minimum(n, self.times[pair % len(self.held)]))
            at = to
        return most


def align(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Best local alignment scores of the rows of a (items, padded) with those of b (stretches, padded)."""
    m, n = len(a), b.shape[1]
    slope = np.arange(1, n + 1) * -GAP
    row, best = np.zeros((m, n + 1), np.int32), np.zeros(m, np.int32)
    inside = np.arange(n)[None, :] < lb[:, None]
    for i in range(a.shape[1]):
        new = np.maximum(row[:, :-1] + np.where((b == a[:, i : i + 1]) & inside, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        # gaps along the stretch: a running maximum of score + slope, minus slope
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        live = i < la
        row[live, 1:] = new[live]
        best = np.where(live, np.maximum(best, new.max(axis=1)), best)
    return best


def scores(slab: Slab, w: tk.Words, least: float = 0.0) -> Iterator[tuple[int, int, float, int, int]]:
    """(document of the batch, item, score, first and last word of the stretch) of the candidate stretches, all that score at least so much among them."""
    hits = []
    for n in slab.lengths:
        grams, at = tk.ngrams(w, n)
        hit, key = slab.find(grams)
        hits.append((at[hit], key))
    where, key = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
    order = np.argsort(where, kind="stable")
    where, key = where[order], key[order]
    upto = np.cumsum(np.append(slab.first[1:], len(slab.gram))[key] - slab.first[key]) if len(where) else where
    # documents at a time, so that pairs of a hit and an item stay bounded
    ends = np.flatnonzero(np.diff(np.searchsorted(w.offsets, where, "right"), append=-1)) + 1
    at = 0
    while at < len(where):
        k = np.searchsorted(upto[ends - 1], (upto[at - 1] if at else 0) + _PAIRS, "right") - 1
        to = ends[max(k, np.searchsorted(ends, at, "right"))]
        yield from _scores(slab, w, where[at:to], key[at:to], least)
        at = to


def _scores(slab: Slab, w: tk.Words, at: np.ndarray, key: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int, int]]:
    upto = np.append(slab.first[1:], len(slab.gram))
    times = upto[key] - slab.first[key]
    where = np.repeat(at, times)
    run = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(slab.first[key], times)
    item, place = slab.item[run], slab.place[run]
    doc = np.searchsorted(w.offsets, where, "right") - 1
    size = slab.offsets[item + 1] - slab.offsets[item]
    slack = size // 3 + 2
    lo = np.maximum(where - place - slack, w.offsets[doc])
    hi = np.minimum(where - place + size + slack, w.offsets[doc + 1])
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    # stretches of one document and item that overlap become one
    base = np.int64(len(w.hash) + 1)
    pair = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(item) != 0)]))
    far = np.maximum.accumulate(hi + pair * base) - pair * base
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (lo[1:] > far[:-1])])
    head = np.flatnonzero(new)
    doc, item, lo, hi = doc[head], item[head], lo[head], np.maximum.reduceat(hi, head)
    la = slab.offsets[item + 1] - slab.offsets[item]
    near = slab.most_matches(w, item, lo, hi) / la >= least
    doc, item, lo, hi, la = doc[near], item[near], lo[near], hi[near], la[near]
    lb = hi - lo
    order = np.lexsort((lb, la))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * lb[order[at : to + 1]].max() <= _CELLS // 16:
            to += 1
            if to - at >= 4096:
                break
        rows = order[at:to]
        a, b = np.zeros((len(rows), la[rows].max()), np.uint64), np.zeros((len(rows), lb[rows].max()), np.uint64)
        for k, r in enumerate(rows):
            a[k, : la[r]] = slab.words[slab.offsets[item[r]] : slab.offsets[item[r] + 1]]
            b[k, : lb[r]] = w.hash[lo[r] : hi[r]]
        got = align(a, la[rows], b, lb[rows])
        for r, s in zip(rows, got, strict=True):
            yield int(doc[r]), int(item[r]), s / (MATCH * la[r]), int(lo[r] - w.offsets[doc[r]]), int(hi[r] - w.offsets[doc[r]])
        at = to


def slabs(benchmark: DataFrame, most: int | None = None) -> Iterator[Slab]:
    """The benchmark in bounded parts; each is brought to the driver by itself. The texts of an id are in one part."""
    ids, texts, n = [], [], 0
    most = SLAB if most is None else most
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text")
    for i, t in rows.toLocalIterator():
        if n >= most and i != ids[-1]:
            yield Slab(ids, texts)
            ids, texts, n = [], [], 0
        ids.append(i)
        texts.append(t)
        n += len(t.split())
    if ids:
        yield Slab(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, from_word, to_word: the best stretch of each item that a document holds."""
    spark, found = docs.sparkSession, None
    small_batches(spark)
    for slab in slabs(benchmark):
        sent = spark.sparkContext.broadcast(slab)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            slab = sent.value
            for batch in batches:
                for part in tk.slices(batch, "text"):
                    best: dict[tuple[int, int], tuple[float, int, int]] = {}
                    for d, i, s, lo, hi in scores(slab, tk.words(part.column("text")), score):
                        k = (d, int(slab.ids[i]))
                        if s >= score and (k not in best or (s, -lo) > (best[k][0], -best[k][1])):
                            best[k] = (s, lo, hi)
                    if best:
                        ids = part.column("doc_id").take(pa.array([d for d, _ in best]))
                        cols = [ids, pa.array([i for _, i in best], pa.int64()), *(pa.array(c) for c in zip(*best.values(), strict=True))]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "score", "from_word", "to_word"])

        part = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, item_id long, score double, from_word long, to_word long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, from_word long, to_word long")
    return found


def holds_none(sent: Broadcast, score: float):  # noqa: ANN201
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for part in tk.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            out.append(np.ones(part.num_rows, bool))
            for d, _, s, _, _ in scores(sent.value, tk.words(part.column(0)), score):
                out[-1][d] &= s < score
        return pa.array(np.concatenate(out))

    return clean


def reject_contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """The documents that hold no item, all columns, texts unmoved: a filter a slab, from which only yes or no comes back from Python."""
    small_batches(docs.sparkSession)
    for slab in slabs(benchmark):
        docs = docs.where(holds_none(docs.sparkSession.sparkContext.broadcast(slab), score)(docs["text"]))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)


QUERIES = {"op9_decontaminate": query}
SQL: dict[str, str] = {}

"""Token counts of a byte-level BPE tokenizer by a two-tier lookup on the map side.

A text falls into pre-tokens by the tokenizer's pattern, and its count is the sum of the pre-tokens' lengths in tokens.
Tier one is a compact hash table of frequent pre-tokens and their lengths, the same `FREQUENT` entries at any input size,
broadcast with the task. Tier two is a cache in each worker: a miss is encoded once and kept while the cache has room.
No pre-token is shuffled.

Which pre-tokens are frequent is found over all documents: each task keeps a Misra-Gries summary of at most `SUMMARY`
words (its counts are exact up to a known error), and the summaries, bounded lists of a few thousand words a task, are
added up. The table only speeds counting up: counts are exact for any table.

Defined cases: null and empty texts have 0 tokens; special tokens' strings are ordinary text; every row has one result
row, equal rows equal counts, null ids too; other columns are never read.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FREQUENT, SUMMARY, CACHE = 16_384, 8_192, 400_000

_ANY = regex.compile(PATTERN)
#: The same on ASCII texts, for the faster engine; the four controls that engines disagree on go the other way.
_ASCII = re.compile(r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
_ODD = re.compile("[\x1c-\x1f]")
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def pretokens(text: str) -> list[str]:
    if text.isascii() and not _ODD.search(text):
        return _ASCII.findall(text)
    return _ANY.findall(text)


class Lengths(dict):
    """Pre-token -> number of tokens; holds the frequent ones for good and others up to CACHE."""

    def __init__(self, frequent: dict[str, int], path: str) -> None:
        super().__init__(frequent)
        self.frequent, self.core = frequent, encoding(path)._core_bpe

    def __missing__(self, token: str) -> int:
        n = len(self.core.encode_single_piece(token.encode("utf-8", "surrogatepass")))
        if len(self) >= CACHE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        if len(token) <= 64:
            self[token] = n
        return n


def count(text: str, lengths: Lengths) -> int:
    return sum(map(lengths.__getitem__, pretokens(text)))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                held.update(text.as_py().split())
                if len(held) > 16 * SUMMARY:
                    held = _shrink(held)
    held = Counter(dict(_shrink(held)))
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _shrink(held: Counter) -> Counter:
    """Misra-Gries: take the count of the first word that must go off all that stay."""
    if len(held) <= SUMMARY:
        return held
    top = held.most_common(SUMMARY + 1)
    least = top[-1][1]
    return Counter({w: n - least for w, n in top[:-1] if n > least})


def frequent_lengths(docs: DataFrame, path: str = VOCABULARY, most: int = FREQUENT) -> dict[str, int]:
    found = docs.select("text").mapInArrow(_summaries, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most // 2)
    core, out = encoding(path)._core_bpe, {}
    for (word,) in found.select("word").collect():
        for form in (" " + word, word):
            for piece in pretokens(form):
                if len(piece) <= 64 and len(out) < most:
                    out[piece] = len(core.encode_single_piece(piece.encode()))
    return out


def token_counts(docs: DataFrame, path: str = VOCABULARY, frequent: dict[str, int] | None = None) -> DataFrame:
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path) if frequent is None else frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(table.value, path)
        for batch in batches:
            n = [count(t.as_py(), lengths) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_token_counts": query}
SQL: dict[str, str] = {}

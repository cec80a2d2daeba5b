"""Heading-aware chunks: split at headings up to a depth, then pack blocks up to a number of characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sentence_spans
from tessera.operators.views import heading_path, infer_headings
from tessera.session import small_batches

SOLID = frozenset(("table", "codeblock", "math_block"))
OUT = "doc_id long, section int, piece int, first_block int, last_block int, text string, n_chars int"
#: Sections that are Python objects at once.
SLICE = 64


def words(text: str) -> int:
    """Tokens where the caller has no tokenizer of their own."""
    return len(text.split())


def pack(blocks: list[tuple[int, str, str]], most: int, overlap: int = 0, size_of: Callable[[str], int] = len) -> list[list[tuple[int, str, str]]]:
    """Greedy packing of (index, type, text) by characters, or what `size_of` counts; 0 is no bound.

    A section within the bound is one chunk. Else long paragraphs fall into sentences; tables, code and formulas always
    join the current chunk, headings never open a new one, any other block does if it would pass the bound. overlap:
    so many trailing paragraphs of a chunk are repeated at the head of the next.
    """
    if most <= 0 or sum(size_of(t) for _, _, t in blocks) <= most:
        return [blocks]
    small: list[tuple[int, str, str]] = []
    for i, kind, text in blocks:
        if kind == "paragraph" and size_of(text) > most:
            run = ""
            for a, b in sentence_spans(text):
                s = text[a:b]
                if run and size_of(f"{run} {s}") > most:
                    small.append((i, kind, run))
                    run = s
                else:
                    run = f"{run} {s}" if run else s
            small.append((i, kind, run))
        else:
            small.append((i, kind, text))
    out: list[list[tuple[int, str, str]]] = []
    now: list[tuple[int, str, str]] = []
    size = 0
    for b in small:
        n = size_of(b[2])
        if b[1] not in SOLID and b[1] != "heading" and now and size + n > most:
            out.append(now)
            tail: list[tuple[int, str, str]] = []
            for x in reversed(now):
                if x[1] != "paragraph" or len(tail) >= overlap:
                    break
                tail.insert(0, x)
            now, size = [*tail, b], sum(size_of(x[2]) for x in tail) + n
        else:
            now.append(b)
            size += n
    return [*out, now] if now else out


def chunk(
    blocks: DataFrame, depth: int = 2, most: int = 8000, overlap: int = 0, breadcrumbs: bool = False, max_tokens: int | None = None, count: Callable[[str], int] = words
) -> DataFrame:
    """Chunks of (doc_id, body_index, node_type, heading_depth, text); a section is a group, so a long document isn't one task.

    max_tokens: chunks that `count` finds longer are packed again by tokens; the cheap bound on characters goes first.
    """
    small_batches(blocks.sparkSession, 1 << 20)
    w = Window.partitionBy("doc_id").orderBy("body_index").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when((F.col("node_type") == "heading") & (F.col("heading_depth") <= depth), 1).otherwise(0)
    got = blocks.withColumn("section", F.sum(opens).over(w).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for doc, section, blocks in zip(*(c.slice(at, SLICE).to_pylist() for c in batch.columns), strict=True):
                    parts = pack([(b["body_index"], b["node_type"], b["text"] or "") for b in blocks], most, overlap)
                    if max_tokens:
                        parts = [q for p in parts for q in pack(p, max_tokens, overlap, count)]
                    for k, part in enumerate(parts):
                        rows.append((doc, section, k, part[0][0], part[-1][0], "\n\n".join(t for _, _, t in part), sum(len(t) for _, _, t in part)))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    ordered = F.array_sort(F.collect_list(F.struct("body_index", "node_type", "text")))
    chunks = got.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "section").agg(ordered.alias("blocks")).mapInArrow(run, OUT)
    if not breadcrumbs:
        return chunks
    path = heading_path(blocks, inclusive=True).select("doc_id", F.col("body_index").alias("first_block"), F.array_join("path", " > ").alias("breadcrumb"))
    return chunks.join(path, ["doc_id", "first_block"])


def from_outline(lines: DataFrame, flat: bool = False, **how: object) -> DataFrame:
    """Chunks of plain lines (doc_id, body_index, text) that have no headings yet: those that look like one are promoted first."""
    return chunk(infer_headings(lines, flat).select("doc_id", "body_index", "node_type", "heading_depth", "text"), breadcrumbs=True, **how)

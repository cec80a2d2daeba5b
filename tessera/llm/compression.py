"""Quality rule by compression: zstandard ratios of whole documents and of fixed chunks, inside bands by length.

ratio = bytes / compressed bytes. Repetition compresses too well, noise (keys, base64, random symbols) hardly at all.
A ratio means little without the length, since longer texts compress better, so the limits come from a table of bands
by length. Whole documents are judged by the band of their length; a document longer than a chunk also by its chunks of
`CHUNK` bytes, by the band of the chunk: it is repetitive or incompressible if more than `CHUNK_SHARE` of its bytes lie in
such chunks. Texts shorter than the first band are too short to tell and are kept.

Defined cases: null and empty texts have 0 bytes, null ratios and verdict 'keep'; every row has one result row, equal
rows equal results; chunks are cut at bytes of UTF-8, the last one may be short and is judged by its own length; other
columns are never read. A projection: no shuffle, one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

LEVEL = 3
CHUNK = 4096
CHUNK_SHARE = 0.5
#: From so many bytes: least and greatest ratio of acceptable text.
BANDS = ((128, 0.95, 2.6), (256, 1.1, 3.2), (512, 1.2, 3.8), (1024, 1.3, 4.4), (2048, 1.4, 4.8), (4096, 1.5, 5.2), (16384, 1.55, 5.8), (65536, 1.6, 6.5))
SCHEMA = "doc_id long, n_bytes long, ratio double, low_share double, high_share double, verdict string"


def band(n: int) -> tuple[float, float] | None:
    found = None
    for least, lo, hi in BANDS:
        if n >= least:
            found = (lo, hi)
    return found


def verdict(data: bytes, compress: zstandard.ZstdCompressor) -> tuple[float | None, float, float, str]:
    """ratio, share of bytes in incompressible and in repetitive chunks, and keep / repetitive / incompressible."""
    n = len(data)
    if not n:
        return None, 0.0, 0.0, "keep"
    ratio = n / len(compress.compress(data))
    low = high = 0
    if n > CHUNK:
        for at in range(0, n, CHUNK):
            piece = data[at : at + CHUNK]
            if b := band(len(piece)):
                r = len(piece) / len(compress.compress(piece))
                low += len(piece) * (r < b[0])
                high += len(piece) * (r > b[1])
    b = band(n)
    if b and (ratio > b[1] or high > CHUNK_SHARE * n):
        what = "repetitive"
    elif b and (ratio < b[0] or low > CHUNK_SHARE * n):
        what = "incompressible"
    else:
        what = "keep"
    return ratio, low / n, high / n, what


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            rows.append((doc, len(data), *verdict(data, z)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "ratio", "low_share", "high_share", "verdict"])


def compression_bands(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_compression_bands": query}
SQL: dict[str, str] = {}

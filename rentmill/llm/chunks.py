"""Chunks of documents, for operators that ask the whole corpus about what a document contains.

Documents are dealt to chunks of about ``CHUNK_BYTES`` of text (less in small tables, so that all cores have some) by
a hash of doc_id, those without doc_id by a hash of their text. A chunk asks about each distinct
item it contains once, so the shuffle grows with distinct items a chunk, not with occurrences; an item as common as
can be costs a row or two a chunk. Replies come back by chunk and meet the documents there. Texts are shuffled once,
each compressed; every step that groups the result of ``dealt`` by chunk shares that one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .words import slices

CHUNK_BYTES, LEAST_BYTES = 8 << 20, 1 << 20
#: Numbers from here on are documents without doc_id, which all count as the last one.
NULLS, SPREAD = (1 << 63) - (1 << 30), (1 << 30) - 1
#: Columns that are added to documents; the names keep clear of theirs.
ORDER, CHUNK, PACKED = "_rm_order", "_rm_chunk", "_rm_packed"


def chunk_count(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    busy = min(2 * docs.sparkSession.sparkContext.defaultParallelism, total // LEAST_BYTES)
    return max(1, math.ceil(total / chunk_bytes), busy)


def order_of(doc_id: Column, text: Column) -> Column:
    """doc_id as a number to compare by; null is one of the numbers from NULLS on, by its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULLS) + F.pmod(F.xxhash64(text), F.lit(SPREAD)))


def chunk_of(order: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(order), F.lit(count)).cast("int")


def dealt(docs: DataFrame, count: int, by: Column | None = None) -> DataFrame:
    """``docs`` with ORDER and CHUNK, and with the text compressed in the column PACKED. Chunks follow from ORDER, or
    from ``by``, a number of each row."""
    docs = docs.withColumn(ORDER, order_of(F.col("doc_id"), F.col("text")))
    docs = docs.withColumn(CHUNK, chunk_of(F.col(ORDER) if by is None else by, count))
    names = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in names] + [StructField(PACKED, BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch):
                packed = [compress(t) if t is not None else None for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(packed, pa.binary())], schema.fieldNames())

    return docs.select(*names, "text").mapInArrow(pack, schema)


def unpacked(table: pa.Table, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a chunk that ``dealt`` made, with their texts in place of PACKED."""
    expand = zstandard.ZstdDecompressor().decompress
    at = table.schema.get_field_index(PACKED)
    for batch in table.to_batches(max_chunksize=512):
        texts = pa.array([expand(t) if t is not None else None for t in batch.column(at).to_pylist()], pa.binary()).cast(pa.string())
        columns, names = list(batch.columns), list(batch.schema.names)
        columns[at], names[at] = texts, "text"
        yield from slices(pa.RecordBatch.from_arrays(columns, names), limit=limit)

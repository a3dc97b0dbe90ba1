"""What the operators share: small batches of texts, and keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

from ..tables import materialise, new_path, shared_dir

__all__ = ["content_hash", "materialise", "new_path", "row_keys", "shared_dir", "small_batches"]


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Send batches of about ``size`` to Python, or of one row, so that neither side buffers many long texts. This is
    read when a query runs, so it stays set for the session; a smaller setting of the session's own is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < as_bytes(spark.conf.get(name)) <= as_bytes(size):
        spark.conf.set(name, size)


def row_keys(*more: str) -> dict[str, Column]:
    """128 bits of doc_id, text and ``more``, equal for repeated rows only; ``key`` alone may be equal by chance."""
    names = ["doc_id", "text", *more]
    return {"key": F.xxhash64(*names), "check": F.xxhash64(F.lit(1), *names)}


def content_hash(df: DataFrame) -> Column:
    """A number to order repeated rows by that differ in other columns; those that can't be hashed don't count."""
    return F.xxhash64(*(c for c in df.columns if not isinstance(df.schema[c].dataType, MapType)))

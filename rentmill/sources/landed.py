"""Landed files of search pages, cards and details, as tables or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = "page_id long, url string, html string"
CARDS = "page_id long, ord long, href string, text string"
DETAILS = "external_id string, detail string"
RESPONSES = "base string, page long, url string, status long, n_listings long"


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet", stream: bool = False, files: int | None = None) -> DataFrame:
    """The files of ``kind`` (parquet or json, one object a line) under ``path``. Columns that a file lacks are null, and
    so are the fields of a line that isn't JSON; a stream takes files up as they land, at most ``files`` in a batch."""
    reader = spark.readStream if stream else spark.read
    if stream and files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.schema(schema).format(kind).load(path)

"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task parses at most, about.
TASK_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Where it names none, a temporary one in local
    mode, as in tests; executors on other machines wouldn't see that, so elsewhere it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rentmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rentmill/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: this cuts the lineage, and a lost
    executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows, and at least one a core. Parsing is bound by CPU and what it makes is larger
    than what it reads, so the reader's splits, which are of equal bytes and no smaller than a row group, make tasks that
    grow with the table. The rows are counted, which for Parquet reads footers only, and dealt by ``key``, of which few
    rows have the same value, before anything is derived from them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), key)


def small_batches(spark: SparkSession, size: int) -> None:
    """Send batches of about ``size`` bytes to Python, or of one row, so that neither side buffers many long texts. This
    is read when a query runs, so it stays set for the session; a smaller setting of the session's own is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < as_bytes(spark.conf.get(name)) <= size:
        spark.conf.set(name, str(size))

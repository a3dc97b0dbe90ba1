"""WARC archives of pages, written with an index and read back through it.

Writing: pages meet their verdict (response, or revisit of the smallest page_id with an equal payload) by page_id and
payload digest; only digests are grouped, so no page moves for its copies' sake, and a payload that a third of all
pages share is counted by map-side combining. Each task writes archive files of about ``file_bytes``, one gzip member
a record, under a name of its own, and yields an index row per record: file, offset, length, URL and digest. The index
is written as a table; a task that is run again writes other files, and the index only names those of the task that
counted.

Reading: the index is the first thing read. The selected records are dealt by file and range of offsets, sorted by
offset, and neighbouring ranges are joined to one read of at most ``read_bytes``.

Null html is an empty payload, null URLs are empty. Of repeated rows the first is the response and the others revisit
it. A null page_id is larger than any other; where all pages of a payload have none, the first by URL is the response
and the others revisit it, without naming it. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import new_path

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
DATE = "2026-01-01T00:00:00Z"
FILE_BYTES, READ_BYTES, GAP = 64 << 20, 4 << 20, 64 << 10
#: Bytes of archives that a reading task is given, about.
TASK_BYTES = 32 << 20


def verdicts(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha, of each page, with copy_of: the smallest page_id with an equal payload of at least ``min_bytes``
    (null for smaller payloads, and where all page_ids are null), and ``grouped``, null for smaller payloads."""
    each = pages.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("bytes"))
    first = each.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("copy_of"), F.lit(True).alias("grouped"))
    return each.select("page_id", "sha").distinct().join(first, "sha", "left")


def record(page_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """One WARC record. A revisit has no payload; its headers say how long the full one is."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{kind}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Page-ID: {refers_to}",
            f"WARC-Payload-Length: {len(payload)}",
        ]
    block = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict[str, object]:
    """What one record says; of a response, length and digest are those of the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base32(payload) != digest:
        raise ValueError(f"a damaged record: {fields['WARC-Record-ID']}")
    return {
        "page_id": int(fields["WARC-Page-ID"]) if fields.get("WARC-Page-ID") else None,
        "url": fields.get("WARC-Target-URI", ""),
        "record_type": kind,
        "refers_to": int(fields["WARC-Refers-To-Page-ID"]) if kind == "revisit" and fields["WARC-Refers-To-Page-ID"] != "None" else None,
        "payload_digest": digest,
        "payload_bytes": len(payload) if payload is not None else int(fields["WARC-Payload-Length"]),
        "payload": payload,
    }


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``path`` in the shared folder; gives the index, as a table there."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    facts = verdicts(rows, min_bytes)
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_page")
    rows = rows.select("*", key, F.sha1("payload").alias("sha"))
    # Join and window use the same plain columns, so pages are shuffled once.
    rows = rows.join(facts.select(key, "sha", "copy_of", "grouped"), ["_page", "sha"])
    nth = F.row_number().over(W.partitionBy("_page", "sha").orderBy("url"))
    another = ~F.col("copy_of").eqNullSafe(F.col("page_id"))
    revisit = F.coalesce("grouped", F.lit(False)) & (another | (nth > 1))
    rows = rows.withColumn("revisit", revisit).select("page_id", "url", "payload", "revisit", "copy_of")
    files = f"{path}/archive"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(files)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            made = []
            for at in range(batch.num_rows):
                page_id, url, payload, again, first = (batch.column(c)[at].as_py() for c in range(5))
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest, kind = base32(payload), "revisit" if again else "response"
                url = " ".join(url.split())
                raw = gzip.compress(record(page_id, url, kind, first, digest, payload), 1, mtime=0)
                out.write(raw)
                made.append((page_id, url, digest, kind, first if again else None, name, offset, len(raw)))
                offset += len(raw)
            yield _batch(made, INDEX)
        if out is not None:
            out.close()

    rows.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    return index.withColumn("archive", F.lit(files))


def read_archive(index: DataFrame, read_bytes: int = READ_BYTES, gap: int = GAP) -> DataFrame:
    """The records that ``index`` selects, each parsed and its payload's digest verified. They are dealt to tasks by the
    bytes to be read, not by the size of the index."""
    area = F.floor(F.col("offset") / F.lit(2 * read_bytes))
    wanted = index.select("archive", "file", "offset", "length").withColumn("area", area)
    total = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(math.ceil(total / TASK_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    wanted = wanted.repartition(tasks, "archive", "file", "area").sortWithinPartitions("archive", "file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, source, opened = None, None, None

        def fetch(ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            start, end = ranges[0][0], sum(ranges[-1])
            block = source.read_at(end - start, start)
            found = [parse(gzip.decompress(block[o - start : o - start + n])) for o, n in ranges]
            return _batch([tuple(r[f.split()[0]] for f in RECORD.split(", ")) for r in found], RECORD)

        ranges: list[tuple[int, int]] = []
        for batch in batches:
            for archive, file, offset, length in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                here = (archive, file)
                if ranges and (here != opened or offset - sum(ranges[-1]) > gap or offset + length - ranges[0][0] > read_bytes):
                    yield fetch(ranges)
                    ranges = []
                if here != opened:
                    fs, root = _open(archive)
                    source, opened = fs.open_input_file(f"{root}/{file}"), here
                ranges.append((offset, length))
        if ranges:
            yield fetch(ranges)

    return wanted.mapInArrow(read, RECORD)

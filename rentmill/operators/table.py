"""The stored table of listings, which each run and each batch of a stream finds as the last one left it.

Rows are dealt to parts by a hash of their key. A manifest names the folder of each part; the newest manifest is the
table. An upsert reads only the parts that its batch touches, joins them with it, writes them anew, and commits a
manifest with these parts' new folders and the others' old ones by a rename that fails if the version exists. Until
then nothing that is written counts, so a crash leaves the last version, and of two writers that start from one version
one fails with ``Conflict`` and loses nothing of the other.

A manifest also keeps, for each stream, the last batch that is in the table: a batch that is run again after a crash
between this commit and the stream's own is recognised and left alone.

The counters of a run are observed while its rows are written; neither the batch nor the table is read for them.

A part's rows lie on shelves by their verdict and by how long before the run they were last seen. The manifest has each
shelf's number of rows and the times between which these were last seen, so a report of the newest rows of a verdict
reads only shelves that can have one of them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..tables import new_path
from . import views
from .store import BOOK, COUNTERS, KEY, VERDICTS, counted, counting, first_merge, merge

PARTS = 64
DAY = 86_400
#: Rows that the run saw have a shelf of their own; others one for each of these ages, in seconds, and one beyond.
AGES = (0, DAY, 7 * DAY)
SEEN = "last_seen_at"


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table; run it again."""


@dataclass(frozen=True)
class Manifest:
    version: int
    parts: int
    schema: dict
    #: Part -> folder, relative to the table's.
    folders: dict[str, str]
    #: Stream -> its last batch in the table.
    ledger: dict[str, int] = field(default_factory=dict)
    #: Folders that were only ever added, for tables that keep a log beside their parts; and whether rows of it are void.
    log: list[str] = field(default_factory=list)
    rebased: bool = False
    #: Part -> shelf -> its number of rows, and the microseconds at which the first and the last of these was last seen
    #: (first: none if a row has no such time). Of tables without shelves empty.
    shelves: dict[str, dict[str, list[int | None]]] = field(default_factory=dict)


@dataclass(frozen=True)
class Staged:
    """A batch, written once, with the parts and platforms that were seen in it meanwhile."""

    rows: DataFrame
    parts: frozenset[int]
    platforms: frozenset[str]
    #: The latest value of its time column, if it has one.
    latest: datetime | None = None


@dataclass(frozen=True)
class Upserted:
    version: int | None
    #: Rows of ``store.COUNTERS``.
    counters: list[tuple]
    parts_read: int = 0
    parts_written: int = 0
    #: Whether the ledger had the batch already.
    repeated: bool = False


def part_of(parts: int, key: Sequence[str] = KEY) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def verdict_shelf(verdict: str | None) -> str:
    return verdict if verdict in VERDICTS else "other"


def shelf_of(run_at: Column) -> Column:
    """The shelf of a row of the table as of ``run_at``."""
    age = F.unix_micros(run_at.cast("timestamp")) - F.unix_micros(F.col(SEEN).cast("timestamp"))
    band = F.lit(len(AGES))
    for n, seconds in reversed(tuple(enumerate(AGES))):
        band = F.when(age <= seconds * 1_000_000, n).otherwise(band)
    return F.concat(F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("other"), F.lit("-"), band.cast("string"))


class PartedTable:
    """A table in the folder ``root``, which all executors share; ``parts`` counts when it is first written."""

    #: The columns by which rows are dealt to parts.
    key: Sequence[str] = KEY

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS) -> None:
        self.spark, self.root, self.new_parts = spark, root.rstrip("/"), parts

    def newest(self) -> Manifest | None:
        versions = self._versions()
        return self.manifest(versions[-1]) if versions else None

    def manifest(self, version: int) -> Manifest:
        text = self.spark.read.text(self._manifest_path(version), wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def version(self) -> int | None:
        """The newest version, before the first none."""
        return (self._versions() or [None])[-1]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of ``version``, by default the newest; none if there is none."""
        version = self.version() if version is None else version
        return None if version is None else self._rows(self.manifest(version), None)

    def expire(self, keep: int = 2, orphans_after: int = 7 * DAY) -> None:
        """Remove all but the last ``keep`` versions, what only they had, and what writers that never committed left
        behind ``orphans_after`` seconds ago or earlier."""
        fs, versions = self._fs(), self._versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        needed = {f for m in kept for f in (*m.folders.values(), *m.log)}
        old = {f for v in versions[:-keep] for f in self.manifest(v).folders.values()} - needed
        for v in versions[:-keep]:
            fs.delete(self._path(self._manifest_path(v)), False)
        for f in old:
            fs.delete(self._path(f"{self.root}/{f}"), True)
        in_use = {f.split("/")[1] for f in needed}
        data = self._path(f"{self.root}/data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in in_use and s.getModificationTime() / 1000 <= time.time() - orphans_after:
                fs.delete(s.getPath(), True)

    def _rows(self, m: Manifest, parts: Iterable[str] | None) -> DataFrame:
        schema = StructType.fromJson(m.schema)
        paths = []
        for p in m.folders if parts is None else parts:
            paths += [f"{self.root}/{m.folders[p]}/shelf={s}" for s in m.shelves[p]] if p in m.shelves else [f"{self.root}/{m.folders[p]}"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _versions(self) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _commit(self, m: Manifest) -> None:
        jvm, final = self.spark._jvm, self._path(self._manifest_path(m.version))
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs().create(draft, False)
        stream.write(bytearray(json.dumps(asdict(m)).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, no_options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {m.version} of {self.root} exists") from e
            raise

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:020d}.json"

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):  # noqa: ANN202
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(
        self, rows: DataFrame, parts: int, touched: Iterable[int], *observed: Column, seen: Observation | None = None, shelf: Column | None = None
    ) -> tuple[dict[str, str], dict]:
        """Write ``rows``, all of the parts ``touched``; their folders, and the schema. What is observed is counted where
        tasks write: work that is done again for a lost executor before that counts once."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("part", part_of(parts, self.key)).hint("rebalance", "part")
        out = dealt.observe(seen, *observed).drop(*BOOK, "fresh") if seen else dealt
        by = ["part"] if shelf is None else ["part", "shelf"]
        laid = out if shelf is None else out.withColumn("shelf", shelf)
        laid.write.partitionBy(*by).parquet(f"{self.root}/{folder}")
        return {str(p): f"{folder}/part={p}" for p in touched}, out.drop("part").schema.jsonValue()


class ListingsTable(PartedTable):
    """The stored listings."""

    def stage(self, batch: DataFrame, at: str | None = None) -> Staged:
        """Write ``batch`` (rows of the table with ``seq``, without times) for ``upsert``; it is computed once."""
        last = self.newest()
        return stage(batch, last.parts if last else self.new_parts, at)

    def upsert(self, staged: list[Staged], run_at: Column, stream: tuple[str, int] | None = None) -> Upserted:
        """Bring the rows of ``staged`` into the table at the time ``run_at``, as batch ``stream`` (stream, batch) if that
        is given. Without rows the table stays; a stream's batch is noted even so."""
        last = self.newest()
        if stream and last and last.ledger.get(stream[0], -1) >= stream[1]:
            return Upserted(last.version, [], repeated=True)
        staged = [s for s in staged if s.parts]
        if not staged:
            if stream and last:
                self._commit(replace(last, version=last.version + 1, ledger=last.ledger | dict([stream])))
            return Upserted(self.version(), [])
        parts = last.parts if last else self.new_parts
        touched = sorted(frozenset().union(*(s.parts for s in staged)))
        platforms = sorted(frozenset().union(*(s.platforms for s in staged)))
        batch = staged[0].rows
        for more in staged[1:]:
            batch = batch.unionByName(more.rows)
        known = [str(p) for p in touched if last and str(p) in last.folders]
        rows = first_merge(batch, run_at) if last is None else merge(self._rows(last, known), batch, run_at)
        seen = Observation()
        written, schema = self._write(rows, parts, touched, *counting(platforms), seen=seen, shelf=shelf_of(run_at))
        folders = (last.folders if last else {}) | written
        shelves = (last.shelves if last else {}) | self._stocked(next(iter(written.values())).rpartition("/")[0])
        ledger = (last.ledger if last else {}) | (dict([stream]) if stream else {})
        version = last.version + 1 if last else 0
        self._commit(Manifest(version, parts, schema, folders, ledger, shelves=shelves))
        return Upserted(version, counted(platforms, seen.get), len(known), len(touched))

    def newest_rows(self, verdict: str = "match", limit: int = 50) -> DataFrame | None:
        """``views.newest`` of the table, read from the shelves that can have one of its rows; none before the first
        version."""
        last = self.newest()
        if last is None:
            return None
        chosen, since = self.shelves_of_newest(last, verdict, limit)
        schema = StructType.fromJson(last.schema)
        paths = [f"{self.root}/{last.folders[p]}/shelf={s}" for p, s in chosen]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if since is not None:
            rows = rows.where(F.col(SEEN) >= F.timestamp_micros(F.lit(since)))
        return views.newest(rows, verdict, limit)

    @staticmethod
    def shelves_of_newest(m: Manifest, verdict: str | None, limit: int) -> tuple[list[tuple[str, str]], int | None]:
        """The shelves (part, shelf) that can have one of the ``limit`` newest rows of ``verdict``, and the microseconds
        since which these were last seen, where that is known: shelves whose rows were all seen since then have
        ``limit`` rows together, so a shelf whose last row was seen earlier has none of the newest."""
        own = verdict_shelf(verdict)
        shelves = [(p, s, *stock) for p, of_part in m.shelves.items() for s, stock in of_part.items() if s.rpartition("-")[0] == own]
        since, certain = None, 0
        # Rows of the shelf for other verdicts can't be counted on.
        countable = [x for x in shelves if x[3] is not None and own == verdict]
        for _, _, rows, first, _ in sorted(countable, key=lambda x: -x[3]):
            certain += rows
            if certain >= limit:
                since = first
                break
        return [(p, s) for p, s, _, _, newest in shelves if since is None or (newest is not None and newest >= since)], since

    def _stocked(self, folder: str) -> dict[str, dict[str, list[int | None]]]:
        """What lies on the shelves of ``folder``; of the rows only their time is read."""
        rows = self.spark.read.schema(f"{SEEN} timestamp, part int, shelf string").parquet(f"{self.root}/{folder}")
        time = F.unix_micros(SEEN)
        first = F.when(F.count(time) == F.count("*"), F.min(time)).alias("first")
        out: dict[str, dict[str, list[int | None]]] = {}
        for r in rows.groupBy("part", "shelf").agg(F.count("*").alias("n"), first, F.max(time).alias("newest")).collect():
            out.setdefault(str(r.part), {})[r.shelf] = [r.n, r.first, r.newest]
        return out

    def counters(self, done: Upserted) -> DataFrame:
        return self.spark.createDataFrame(done.counters, COUNTERS)


def stage(batch: DataFrame, parts: int, at: str | None = None, key: Sequence[str] = KEY) -> Staged:
    """Write ``batch`` without its time column ``at``, and see meanwhile what is in it."""
    spark, path, seen = batch.sparkSession, new_path(batch.sparkSession, "batch"), Observation()
    platform = F.col("platform") if "platform" in batch.columns else F.lit(None).cast("string")
    what = {"parts": F.collect_set(part_of(parts, key)), "platforms": F.collect_set(platform), "latest": F.max(at) if at else F.max(F.lit(None))}
    observed = batch.observe(seen, *(c.alias(n) for n, c in what.items()))
    out = observed.drop(at) if at else observed
    out.write.parquet(path)
    found = seen.get
    return Staged(spark.read.schema(out.schema).parquet(path), frozenset(found["parts"]), frozenset(found["platforms"]), found["latest"])

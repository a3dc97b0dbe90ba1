"""A run over several sources: collected, judged, upserted, and reported on."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators import store
from ..operators.criteria import Criteria, judge
from ..operators.table import ListingsTable, Staged, stage
from ..tables import new_path


@dataclass(frozen=True)
class Source:
    """``listings`` gives the rows that the source has, with ``seq``, their order; ``stopped`` why it stopped early."""

    platform: str
    listings: Callable[[], DataFrame]
    stopped: Callable[[], str | None] = lambda: None


@dataclass(frozen=True)
class Run:
    batch: DataFrame | None
    table: DataFrame | None
    counters: DataFrame
    #: The platforms that failed, with the traceback. One that has counters too failed after its rows were there.
    failures: dict[str, str]


@dataclass(frozen=True)
class Collected:
    """What sources gave: their rows, judged and written; why they stopped (platform, stopped_early); what failed."""

    staged: list[Staged]
    stops: list[tuple[str, str | None]]
    failures: dict[str, str]


def collect(sources: Sequence[Source], c: Criteria, parts: int = 1) -> Collected:
    """Each source is judged and written by itself, so one that fails costs its own rows only. A source whose rows are
    written has run: if the reason why it stopped can't be found, that is a failure and stands in its place."""
    staged, stops, failures = [], [], {}
    for source in sources:
        try:
            staged.append(stage(store.to_rows(judge(source.listings(), c)), parts))
        except Exception:  # noqa: BLE001  (whatever it is, it must not sink the other sources)
            failures[source.platform] = traceback.format_exc()
            continue
        try:
            stops.append((source.platform, source.stopped()))
        except Exception as e:  # noqa: BLE001
            failures[source.platform] = traceback.format_exc()
            stops.append((source.platform, f"unknown: {e}"))
    return Collected(staged, stops, failures)


def with_stops(spark: SparkSession, counters: list[tuple], stops: list[tuple[str, str | None]]) -> DataFrame:
    ran = spark.createDataFrame(stops, "platform string, stopped_early string")
    return store.with_stops(spark.createDataFrame(counters, store.COUNTERS), ran)


def run(spark: SparkSession, sources: Sequence[Source], stored: DataFrame | None, run_at: Column, c: Criteria = Criteria()) -> Run:
    """What the sources have is upserted into ``stored`` (none: a new table) in one join, and written as a new snapshot;
    rejected listings are kept like all others. A source without listings counts as a source that ran."""
    got = collect(sources, c)
    filled = [s for s in got.staged if s.parts]
    if not filled:
        return Run(None, stored, with_stops(spark, [], got.stops), got.failures)
    batch = filled[0].rows
    for more in filled[1:]:
        batch = batch.unionByName(more.rows)
    platforms, seen = sorted(frozenset().union(*(s.platforms for s in filled))), Observation()
    rows = store.first_merge(batch, run_at) if stored is None else store.merge(stored, batch, run_at)
    path = new_path(spark, "snapshot")
    out = rows.observe(seen, *store.counting(platforms)).drop(*store.BOOK, "fresh")
    out.write.parquet(path)
    table = spark.read.schema(out.schema).parquet(path)
    return Run(batch, table, with_stops(spark, store.counted(platforms, seen.get), got.stops), got.failures)


def run_into(table: ListingsTable, sources: Sequence[Source], run_at: Column, c: Criteria = Criteria()) -> Run:
    """``run`` against a table that the next run finds: only the parts that the batch touches are read and written."""
    last = table.newest()
    got = collect(sources, c, last.parts if last else table.new_parts)
    done = table.upsert(got.staged, run_at)
    return Run(None, table.read(), with_stops(table.spark, done.counters, got.stops), got.failures)

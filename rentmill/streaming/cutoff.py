"""Which pages of a search count, kept up to date while its responses arrive in any order.

Pages count up to the first that ends their search. What is stored of a search is its pages that count so far and its
first ending page so far; a response is compared with these only. An ending page that arrives late retracts the pages
after it, a page that arrives after the end it lies behind never counts. Ends only move forward, so nothing that was
left out is ever missed, and any order of arrival, in any batches, gives what ``frontier.kept_responses`` gives of all
responses at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.table import Manifest, PartedTable, stage
from ..sources import frontier
from .upserts import stream_id

COLUMNS = ("base", "page", "url", "status", "n_listings")


class PageCutoff(PartedTable):
    """The searches in the folder ``root``, dealt to parts by their base."""

    key = ("base",)

    def append(self, responses: DataFrame, stream: tuple[str, int] | None = None) -> int | None:
        """Add ``responses`` (base, page, url, status, n_listings), as batch ``stream`` (stream, batch) if that is given.
        The new version; batches that the ledger has, and those without rows, leave the table as it is."""
        last = self.newest()
        if stream and last and last.ledger.get(stream[0], -1) >= stream[1]:
            return last.version
        parts = last.parts if last else self.new_parts
        staged = stage(responses.select(*COLUMNS), parts, key=self.key)
        if not staged.parts:
            return self.version()
        touched = sorted(staged.parts)
        known = [str(p) for p in touched if last and str(p) in last.folders]
        rows = staged.rows.unionByName(self._rows(last, known)) if known else staged.rows
        folders, schema = self._write(frontier.open_responses(rows), parts, touched)
        ledger = (last.ledger if last else {}) | (dict([stream]) if stream else {})
        version = last.version + 1 if last else 0
        # A search always has a row, be it its end; a part whose responses were all blocked has none, and no folder.
        filled = {p: f for p, f in folders.items() if self._fs().exists(self._path(f"{self.root}/{f}"))}
        before = {p: f for p, f in (last.folders if last else {}).items() if p not in folders}
        self._commit(Manifest(version, parts, schema, before | filled, ledger))
        return version

    def kept(self, version: int | None = None) -> DataFrame:
        """The pages that count as of ``version``, by default the newest, with ``stop_reason``."""
        rows = self.read(version)
        if rows is None:
            rows = self.spark.createDataFrame([], "base string, page long, url string, status long, n_listings long")
        return frontier.kept_responses(rows)

    def changes(self, before: int, after: int | None = None) -> DataFrame:
        """Pages that came to count (``added``) or don't any more between two versions. Repeated responses count once."""
        old, new = self.kept(before).select(*COLUMNS), self.kept(after).select(*COLUMNS)
        return new.exceptAll(old).withColumn("added", F.lit(True)).unionByName(old.exceptAll(new).withColumn("added", F.lit(False))).distinct()


def writer(table: PageCutoff, keep: int = 2, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over streams of responses."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        name = stream or stream_id(batch.sparkSession)
        table.append(batch, (name, batch_id) if name else None)
        table.expire(keep)

    return apply


def run(responses: DataFrame, table: PageCutoff, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Start keeping ``table`` from a stream of ``responses``; ends when all that has landed is done."""
    query = responses.writeStream.foreachBatch(writer(table, keep)).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()

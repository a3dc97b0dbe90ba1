"""Keeping the table of listings up to date from streams: of ready listings, or of landed pages and cards.

Every batch is one upsert of the table that batch runs use too, noted in its ledger under the stream's id. A batch that
is run again, because the job died between the table's commit and the stream's own, is recognised there. A new
checkpoint is a new stream: it reads what has landed from the start and goes on from the table as it is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.criteria import Criteria, judge
from ..operators.store import to_rows
from ..operators.table import ListingsTable, stage
from ..sources import cards, landed, pages


def stream_id(spark: SparkSession) -> str | None:
    """The id of the stream whose batch this thread runs. It lives in the checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def writer(
    table: ListingsTable, c: Criteria = Criteria(), keep: int = 2, stream: str | None = None, listings: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: take the ``listings`` (with ``seq``) of a batch, judge and upsert them. With a
    column ``landed_at`` its latest value is the time of the batch, observed as the batch is written. The last ``keep``
    versions of the table stay, and the one that the batch started from. ``stream`` names the stream in the ledger; by
    default it is the running stream's id."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        name, last = stream or stream_id(batch.sparkSession), table.newest()
        if name and last and last.ledger.get(name, -1) >= batch_id:
            return
        rows = listings(batch)
        at = "landed_at" if "landed_at" in rows.columns else None
        staged = stage(to_rows(judge(rows, c), *filter(None, [at])), last.parts if last else table.new_parts, at)
        run_at = F.current_timestamp() if staged.latest is None else F.lit(staged.latest)
        table.upsert([staged], run_at, (name, batch_id) if name else None)
        table.expire(keep)

    return apply


def run(listings: DataFrame, table: ListingsTable, checkpoint: str, c: Criteria = Criteria()) -> StreamingQuery:
    """Start keeping ``table`` from a stream of ``listings`` (with ``seq``); ends when all that has landed is done."""
    query = listings.writeStream.foreachBatch(writer(table, c)).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


@dataclass(frozen=True)
class Feeds:
    """Folders of landed pages and cards, their kind of file, and how they become listings. ``details`` are texts of
    opened cards (external_id, detail); they are read anew with each batch."""

    pages: str
    cards: str
    details: DataFrame
    kind: str = "parquet"
    page_platform: str = "kijiji"
    host: str = "https://www.kijiji.ca"
    card_platform: str = "facebook"
    #: Most files of each folder in a batch.
    files: int | None = None

    def stream(self, spark: SparkSession) -> DataFrame:
        """Pages and cards as one stream, told apart by ``what``, so that one batch, and one commit, holds both."""
        both = ((self.pages, landed.PAGES, "page"), (self.cards, landed.CARDS, "card"))
        first, second = (
            landed.read(spark, path, schema, self.kind, stream=True, files=self.files).withColumn("what", F.lit(what)) for path, schema, what in both
        )
        return first.unionByName(second, allowMissingColumns=True)

    def listings(self, batch: DataFrame, c: Criteria = Criteria()) -> DataFrame:
        """The listings of a batch: of each key the last, by page."""
        landed_pages = batch.where("what = 'page'").select("page_id", "html")
        of_pages = pages.latest_listings(landed_pages, self.page_platform, self.host).drop("visit")
        anchors = batch.where("what = 'card'").select("page_id", "ord", "href", "text")
        of_cards = cards.worth_opening(cards.to_listings(cards.latest(anchors), self.card_platform), c)
        of_cards = cards.enrich(of_cards, self.details).drop("worth_opening")
        return of_pages.unionByName(of_cards).withColumn("seq", F.col("page_id"))


def run_feeds(feeds: Feeds, table: ListingsTable, checkpoint: str, c: Criteria = Criteria(), keep: int = 2) -> StreamingQuery:
    """Start keeping ``table`` from landed pages and cards; ends when all that has landed is done."""
    apply = writer(table, c, keep, listings=lambda batch: feeds.listings(batch, c))
    query = feeds.stream(table.spark).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()

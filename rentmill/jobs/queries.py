"""The registered queries over listings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.appliances import flags
from ..functions.geo import is_quebec
from ..functions.price import is_short_term
from ..functions.text import fold
from ..operators import replay, store, views
from ..operators.criteria import APPLIANCES, Criteria, judge, parse
from ..operators.history import PriceHistory
from ..operators.table import ListingsTable
from ..sources import cards, frontier, landed, pages, synthetic
from ..streaming import cutoff
from ..streaming.cutoff import PageCutoff
from ..streaming.upserts import Feeds, run_feeds
from ..tables import materialise, new_path
from .run import Run, Source, run

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["platform", "external_id"]
RUN_DAY, RUN_AT = "2024-01-05", "2026-08-01 12:00:00"


def text_md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def number(name: str) -> Column:
    """An exact amount, as a number that compares alike in both engines."""
    return F.col(name).cast("double").alias(name.rpartition(".")[2])


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.derive(spark, sf_dir, synthetic.LISTINGS)
    none = F.lit(None).cast("string")
    return rows.withColumns({
        "url": none, "attributes": F.create_map().cast("map<string,string>"), "posted_at": F.lit(None).cast("timestamp"),
        "seller_name": F.concat(F.lit("Vendeur "), (F.col("seq") % 10).cast("string")), "raw": F.lit("{}"),
    })


def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folded = docs.select("doc_id", fold(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.length("folded").alias("n_chars"), text_md5(F.col("folded")).alias("folded_md5"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse(listings(spark, sf_dir))
    return rows.select(*KEY, number("price.amount"), "price.period", number("price.monthly"), is_short_term(F.col("price")).alias("short_term"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse(listings(spark, sf_dir))
    distance = F.round("place.distance_km", 6).alias("distance_km")
    return rows.select(*KEY, "place.province", "place.city", "place.postal_prefix", distance, "place.evidence", is_quebec(F.col("place")).alias("is_quebec"))


def appliances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse(listings(spark, sf_dir))
    out = [F.col(f"{n}.{part}").alias(f"{n}_{part}") for n in APPLIANCES for part in ("status", "evidence")]
    return rows.select(*KEY, *out)


def dwellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse(listings(spark, sf_dir)).select(*KEY, "dwelling.*")
    return rows.withColumn("is_room", F.col("is_room").cast("string"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(listings(spark, sf_dir))
    return rows.select(*KEY, "verdict", F.array_join("rejections", "|").alias("rejections"), F.array_join("unknowns", "|").alias("unknowns"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(listings(spark, sf_dir)).groupBy("platform", "verdict").agg(F.count("*").alias("n"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows under a higher limit and without the laundry, by transition."""
    loose = replace(Criteria(), max_rent=Decimal(2500), require_washer=False, require_dryer=False)
    return store.transitions(store.replay_stored(_stored(spark, sf_dir, store.REPLAYED), loose))


def search_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = synthetic.derive(spark, sf_dir, synthetic.RESPONSES).select("base").distinct()
    return frontier.frontier(searches)


def kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frontier.kept_responses(synthetic.derive(spark, sf_dir, synthetic.RESPONSES))
    return rows.select("base", "page", "url", "n_listings", "stop_reason")


def streamed_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kept_pages`` kept by a stream of landed responses, the later pages of each search first."""
    root = new_path(spark, "cutoff")
    rows = synthetic.derive(spark, sf_dir, synthetic.RESPONSES)
    table = PageCutoff(spark, f"{root}/table", PARTS)
    for landing in (F.col("page") > 8, (F.col("page") > 4) & (F.col("page") <= 8), F.col("page") <= 4):
        rows.where(landing).select("base", F.col("page").cast("long").alias("page"), "url", "status", "n_listings").write.mode("append").parquet(f"{root}/landed")
        cutoff.run(landed.read(spark, f"{root}/landed", landed.RESPONSES, stream=True), table, f"{root}/checkpoint").awaitTermination()
    return table.kept().select("base", F.col("page").cast("int").alias("page"), "url", "n_listings", "stop_reason")


def page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing on every page, the supplied pages (which hold none) among them."""
    rows = synthetic.derive(spark, sf_dir, synthetic.PAGES)
    real = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    found = pages.latest_listings(rows.unionByName(real), "kijiji", "https://www.kijiji.ca")
    keep = ["page_id", *KEY, "url", "title", "price_text", "location_text", "latitude", "longitude", "seller_name"]
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e.key, F.lit("="), e.value)), "|")
    return found.select(*keep, facts.alias("attributes"), F.contains("raw", F.lit("Vendeur")).alias("raw_names_seller"), F.try_parse_json("raw").isNotNull().alias("raw_is_json"))


def page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of pages with nested and repeated nodes, with their dates, descriptions and attributes, and whether what is
    kept of them is JSON and names a seller (who may stand last, in a node inside the node, or in an object)."""
    found = pages.latest_listings(synthetic.derive(spark, sf_dir, synthetic.NESTED), "kijiji", "https://www.kijiji.ca")
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e.key, F.lit("="), e.value)), "|")
    posted = F.date_format("posted_at", "yyyy-MM-dd HH:mm").alias("posted_at")
    keep = ["page_id", *KEY, "url", "title", "description", "price_text", "location_text", "latitude", "longitude"]
    seen = F.contains("raw", F.lit("Vendeur")).alias("raw_names_seller")
    return found.select(*keep, posted, facts.alias("attributes"), "seller_name", F.try_parse_json("raw").isNotNull().alias("raw_is_json"), seen)


def included(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse(listings(spark, sf_dir))
    return rows.select(*KEY, *(c.alias(n) for n, c in flags({n: F.col(n) for n in APPLIANCES}).items()))


def loose_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged under other criteria: another centre and radius, rooms and unknown provinces allowed, no kitchen asked for."""
    c = Criteria(max_rent=Decimal(1500), min_rent=Decimal(500), require_kitchen=False, exclude_rooms=False, radius_km=25.0, allow_unknown_province=True)
    rows = judge(listings(spark, sf_dir), c)
    return rows.select(*KEY, "verdict", F.array_join("reasons", "|").alias("reasons"))


def detail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``raw`` says of cards and their details."""
    rows = _cards(spark, sf_dir)
    text = lambda name: F.get_json_object("raw", f"$.{name}")
    return rows.select(*KEY, text_md5(text("card_text")).alias("card_md5"), text("detail_text").alias("detail_text"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards harvested, parsed, told worth opening or not, and given their details."""
    anchors = synthetic.derive(spark, sf_dir, synthetic.CARDS)
    opened = cards.worth_opening(cards.to_listings(cards.latest(anchors), "facebook"))
    detail = spark.read.parquet(f"{sf_dir}/customer.parquet")
    detail = detail.select(F.col("c_custkey").cast("string").alias("external_id"), F.concat(F.lit("Laveuse incluse. "), "c_name").alias("detail"))
    return cards.enrich(opened, detail)


def card_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _cards(spark, sf_dir)
    return full.select(*KEY, "url", "title", "price_text", "location_text", "worth_opening", "description")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What was stored before the run day, and the batch of that day."""
    rows = synthetic.derive(spark, sf_dir, synthetic.RUNS).withColumn("price_period", F.when(F.col("price_cad").isNotNull(), "month"))
    middle = F.lit(RUN_DAY).cast("date")
    return rows.where(F.col("run_day") < middle).drop("run_day"), rows.where(F.col("run_day") >= middle).drop("run_day")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, batch = _runs(spark, sf_dir)
    stored = store.first_snapshot(before, F.lit("2026-07-01 00:00:00").cast("timestamp"))
    rows = store.upsert(stored, batch, F.lit(RUN_AT).cast("timestamp"))
    return rows.select(*KEY, "verdict", number("price_cad"), "price_period", day("first_seen_at"), day("last_seen_at"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, batch = _runs(spark, sf_dir)
    return store.run_counters(before, batch)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counters(spark, sf_dir)
    lines = store.summary(c).join(store.rows_written(c), "platform")
    return lines.join(store.run_report(c, F.lit(RUN_AT).cast("timestamp")), "platform")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.derive(spark, sf_dir, synthetic.RUNS).where("price_cad IS NOT NULL")
    seen = rows.select(*KEY, F.col("run_day").alias("seen_at"), "price_cad")
    history = store.price_history(seen)
    return history.groupBy(*KEY).agg(F.count("*").alias("n_seen"), F.count("drop").alias("n_drops"), F.max("drop").cast("double").alias("largest_drop"))


def appended_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``price_history`` kept by three appends, each with observations of all days, so that many come late."""
    rows = synthetic.derive(spark, sf_dir, synthetic.RUNS).withColumnRenamed("run_day", "seen_at")
    kept = PriceHistory(spark, new_path(spark, "history"), PARTS)
    for n in range(3):
        kept.append(rows.where(F.col("seq") % 3 == n))
    history = kept.history()
    return history.groupBy(*KEY).agg(F.count("*").alias("n_seen"), F.count("drop").alias("n_drops"), F.max("drop").cast("double").alias("largest_drop"))


def new_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, batch = _runs(spark, sf_dir)
    at = F.lit(RUN_AT).cast("timestamp")
    stored = store.upsert(store.first_snapshot(before, F.lit("2026-07-01 00:00:00").cast("timestamp")), batch, at)
    return store.new_matches(stored, at).select(*KEY, number("price_cad"))


def _stored(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The stored rows of all listings, or these ``columns`` of them: of what an aggregate keeps of a row as a whole, Spark
    doesn't leave out what is never read."""
    rows = store.to_rows(judge(listings(spark, sf_dir)))
    rows = rows.select(*columns, "seq") if columns else rows
    at = F.lit(RUN_AT).cast("timestamp")
    return store.first_snapshot(rows, at)


def newest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.display(views.newest(_stored(spark, sf_dir), "maybe"))


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, sf_dir)
    return rows.select(*KEY, "verdict", number("price_cad"), "price_period", "city", "rooms", "washer", "seller_hash")


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.derive(spark, sf_dir, synthetic.PAGES)
    return pages.latest_listings(rows, "kijiji", "https://www.kijiji.ca").withColumn("seq", F.col("page_id"))


def _run(spark: SparkSession, sf_dir: str) -> Run:
    """Pages and cards of two sources, and a third source that fails, judged and upserted into what was stored: by the
    rule of this fixture every third listing. Why the cards stopped can't be found, so that source is partial."""

    def card_rows() -> DataFrame:
        return _cards(spark, sf_dir).withColumn("seq", F.lit(0).cast("long"))

    def stopped() -> str | None:
        return frontier.stopped_early(synthetic.derive(spark, sf_dir, synthetic.RESPONSES))

    def broken() -> DataFrame:
        raise ConnectionError("moved")

    def lost() -> str | None:
        raise FileNotFoundError("no log")

    rows = store.to_rows(judge(listings(spark, sf_dir).where("seq % 3 = 0")))
    stored = store.first_snapshot(rows, F.lit("2026-07-01 00:00:00").cast("timestamp"))
    sources = [Source("kijiji", lambda: _page_rows(spark, sf_dir), stopped), Source("craigslist", broken), Source("facebook", card_rows, lost)]
    return run(spark, sources, materialise(stored, "stored"), F.lit(RUN_AT).cast("timestamp"))


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a run, written as the next snapshot and read back."""
    rows = _run(spark, sf_dir).table
    return rows.select(*KEY, "verdict", F.array_join("verdict_reasons", "|").alias("reasons"), number("price_cad"), "price_period", day("first_seen_at"), day("last_seen_at"))


def run_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run, the summary of each platform that ran, and the platforms that failed."""
    done = _run(spark, sf_dir)
    report = store.report_document(done.counters, F.lit(RUN_AT).cast("timestamp"))
    lines = store.summary(done.counters).select(F.concat(F.lit("summary of "), "platform").alias("what"), F.col("summary").alias("said"))
    last = lambda why: why.strip().rpartition(": ")[2]
    failed = spark.createDataFrame([(f"failure of {name}", last(why)) for name, why in done.failures.items()], "what string, said string")
    return report.select(F.lit("report").alias("what"), F.col("report").alias("said")).unionByName(lines).unionByName(failed)


#: Days at which the runs of ``_table_runs`` end, the times of the runs, and the parts of the tables.
RUN_ENDS, RUN_TIMES, PARTS = ("2024-01-11", "2024-01-21", "2024-02-01"), ("2026-08-01", "2026-08-02", "2026-08-03"), 16


def _table_runs(spark: SparkSession, sf_dir: str) -> tuple[ListingsTable, DataFrame]:
    """A table after three runs, each of which finds it as the last one left it, and the counters of all runs."""
    table = ListingsTable(spark, new_path(spark, "table"), PARTS)
    rows = synthetic.derive(spark, sf_dir, synthetic.RUNS).withColumn("price_period", F.when(F.col("price_cad").isNotNull(), "month"))
    counters, start = None, "0001-01-01"
    for n, (end, at) in enumerate(zip(RUN_ENDS, RUN_TIMES, strict=True)):
        batch = rows.where((F.col("run_day") >= F.lit(start).cast("date")) & (F.col("run_day") < F.lit(end).cast("date"))).drop("run_day")
        done = table.upsert([table.stage(batch)], F.lit(at).cast("timestamp"))
        found = table.counters(done).withColumn("run", F.lit(n))
        counters, start = found if counters is None else counters.unionByName(found), end
    return table, counters


def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table_runs(spark, sf_dir)[0].read()
    return rows.select(*KEY, "verdict", number("price_cad"), "price_period", day("first_seen_at"), day("last_seen_at"))


def table_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_runs(spark, sf_dir)[1]


def table_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest maybes of the table after three runs, read from the shelves that can have them."""
    rows = _table_runs(spark, sf_dir)[0].newest_rows("maybe")
    return rows.select(*KEY, "verdict", number("price_cad"), "price_period", day("first_seen_at"), day("last_seen_at"))


def streamed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table kept by a stream of landed pages and cards, which is started anew, from its checkpoint, after each of
    three landings; what a page lands with is its id modulo 3."""
    root = new_path(spark, "streamed")
    table = ListingsTable(spark, f"{root}/table", PARTS)
    details = spark.read.parquet(f"{sf_dir}/customer.parquet")
    details = details.select(F.col("c_custkey").cast("string").alias("external_id"), F.concat(F.lit("Laveuse incluse. "), "c_name").alias("detail"))
    feeds = Feeds(f"{root}/pages", f"{root}/cards", details)
    html = synthetic.derive(spark, sf_dir, synthetic.PAGES).select("page_id", F.lit(None).cast("string").alias("url"), "html")
    anchors = synthetic.derive(spark, sf_dir, synthetic.CARDS).select("page_id", "ord", "href", "text")
    for landing in range(3):
        html.where(F.col("page_id") % 3 == landing).write.mode("append").parquet(feeds.pages)
        anchors.where(F.col("page_id") % 3 == landing).write.mode("append").parquet(feeds.cards)
        run_feeds(feeds, table, f"{root}/checkpoint").awaitTermination()
    rows = table.read()
    return rows.select(*KEY, "url", "title", "verdict", F.array_join("verdict_reasons", "|").alias("reasons"), number("price_cad"), "price_period")


def replayed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows rebuilt from what was kept of their pages and cards, and judged by other criteria: transitions, and in
    how many rows the replay of stored columns says otherwise."""
    loose = replace(Criteria(), max_rent=Decimal(2500), require_washer=False, require_dryer=False)
    rows = _page_rows(spark, sf_dir).drop("page_id", "visit").unionByName(_cards(spark, sf_dir).drop("page_id", "worth_opening").withColumn("seq", F.lit(0).cast("long")))
    stored = materialise(store.first_snapshot(store.to_rows(judge(rows)), F.lit(RUN_AT).cast("timestamp")), "stored")
    both = replay.compared(stored, loose, {"kijiji": replay.pages("https://www.kijiji.ca"), "facebook": replay.cards()})
    return both.groupBy("platform", "before", "after").agg(F.count("*").alias("n"), F.count_if("differs").alias("n_differ"))


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.inspect(listings(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "judge_listings": judged,
    "fold_documents": fold_documents,
    "parse_prices": prices,
    "locate_places": places,
    "detect_appliances": appliances,
    "parse_dwellings": dwellings,
    "verdict_counts": verdict_counts,
    "stored_rows": stored_rows,
    "newest_maybe": newest_matches,
    "inspect_listings": inspected,
    "replay_transitions": replayed,
    "search_frontier": search_frontier,
    "kept_pages": kept_pages,
    "streamed_cutoff": streamed_cutoff,
    "page_listings": page_listings,
    "page_details": page_details,
    "card_listings": card_listings,
    "card_details": detail_texts,
    "included_appliances": included,
    "judge_loosely": loose_verdicts,
    "run_table": run_table,
    "run_document": run_document,
    "table_runs": table_runs,
    "table_counters": table_counters,
    "table_newest": table_newest,
    "streamed_table": streamed_table,
    "replay_from_raw": replayed_raw,
    "upsert_listings": upserted,
    "run_counters": counters,
    "run_summary": run_summary,
    "price_history": price_history,
    "appended_history": appended_history,
    "new_matches": new_matches,
}

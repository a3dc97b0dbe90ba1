"""The table that runs and streams share: what an upsert touches, and what crashes and restarts leave."""

from __future__ import annotations

import json
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rentmill.jobs.run import Source, run_into
from rentmill.operators import replay, store
from rentmill.operators.criteria import Criteria, judge
from rentmill.operators.history import OBSERVED, PriceHistory
from rentmill.operators.table import Conflict, ListingsTable
from rentmill.sources import frontier, pages
from rentmill.streaming.cutoff import PageCutoff
from rentmill.streaming.upserts import Feeds, run_feeds

from .test_jobs import IDEAL, LISTED, page, table

ROW = "platform string, external_id string, title string, verdict string, price_cad decimal(10,2), price_period string, seq int"


def at(day: int):  # noqa: ANN201
    return F.lit(f"2026-08-0{day} 00:00:00").cast("timestamp")


def rows(spark: SparkSession, *values: tuple) -> DataFrame:
    return spark.createDataFrame(values, ROW)


def listed(t: ListingsTable, version: int | None = None) -> list[tuple]:
    return sorted(map(tuple, t.read(version).collect()), key=str)


def test_upserts_equal_one_join_each(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    t = ListingsTable(spark, f"{tmp_path}/t", 4)
    assert t.read() is None and t.version() is None and t.upsert([t.stage(rows(spark))], at(1)).version is None
    batches = [
        rows(spark, ("k", "1", "a", "match", Decimal(900), "month", 1), ("k", "2", "b", "reject", None, None, 2), ("f", "1", "c", "maybe", Decimal(5), "week", 3)),
        rows(spark, ("k", "1", "a2", "maybe", None, None, 1), ("k", "3", "x", "match", Decimal(7), "month", 2), ("k", "3", "y", "match", None, None, 3)),
        rows(spark),
        rows(spark, *(("k", str(i), "z", "reject", None, None, i) for i in range(40))),
    ]
    stored = None
    for day, batch in enumerate(batches, 1):
        want = [] if not batch.count() else store.run_counters(stored if stored is not None else batch.limit(0), batch).collect()
        done = t.upsert([t.stage(batch)], at(day))
        assert sorted(map(tuple, t.counters(done).collect())) == sorted(map(tuple, want))
        stored = store.first_snapshot(batch, at(day)) if stored is None else store.upsert(stored, batch, at(day))
        assert listed(t) == sorted(map(tuple, stored.collect()), key=str)
    assert t.version() == 2 and len(listed(t, 0)) == 3
    t.expire(keep=1)
    assert listed(t) == sorted(map(tuple, stored.collect()), key=str) and t._versions() == [2]


def test_an_upsert_touches_its_parts_only(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    t = ListingsTable(spark, f"{tmp_path}/t", 100)
    many = spark.range(5000).select(F.lit("k").alias("platform"), F.col("id").cast("string").alias("external_id"), F.lit("t").alias("title"), F.lit("match").alias("verdict"), F.lit(None).cast("decimal(10,2)").alias("price_cad"), F.lit(None).cast("string").alias("price_period"), F.col("id").cast("int").alias("seq"))
    assert t.upsert([t.stage(many)], at(1)).parts_written == 100
    before = t.newest().folders
    done = t.upsert([t.stage(many.where("external_id = '77'"))], at(2))
    after = t.newest().folders
    assert (done.parts_read, done.parts_written) == (1, 1) and sum(before[p] != after[p] for p in before) == 1
    read = t._rows(t.newest(), [p for p in before if before[p] != after[p]]).count()
    assert t.read().count() == 5000 and 20 <= read <= 100


def test_a_crash_before_the_commit_leaves_the_last_version(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch) -> None:  # noqa: ANN001
    t = ListingsTable(spark, f"{tmp_path}/t", 4)
    first = rows(spark, ("k", "1", "a", "match", None, None, 1))
    t.upsert([t.stage(first)], at(1))
    before = listed(t)

    def crash(*_) -> None:  # noqa: ANN002
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(ListingsTable, "_commit", crash)
        t.upsert([t.stage(rows(spark, ("k", "2", "b", "match", None, None, 1)))], at(2))
    assert listed(t) == before and len(list(tmp_path.glob("t/data/*"))) == 2
    t.expire(orphans_after=-1)
    assert listed(t) == before and len(list(tmp_path.glob("t/data/*"))) == 1
    taken = t.newest()
    with pytest.raises(Conflict):
        t._commit(taken)
    assert listed(t) == before


def test_the_newest_are_read_from_few_shelves(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    """Runs of all kinds, by day and by minute; after each the report is that of the whole table."""
    t, rng = ListingsTable(spark, f"{tmp_path}/t", 8), random.Random(3)
    assert t.newest_rows() is None
    kinds = ("match", "maybe", "reject", None, "odd")
    for n, (when, size) in enumerate([("01 00:00:00", 400), ("02 00:00:00", 300), ("02 00:01:00", 3), ("20 00:00:00", 40), ("20 00:00:00", 2), ("21 06:00:00", 200)]):
        batch = rows(spark, *((rng.choice("kf"), str(rng.randrange(500)), "t", rng.choice(kinds), None, None, i) for i in range(size)))
        t.upsert([t.stage(batch)], F.lit(f"2026-08-{when}").cast("timestamp"))
        stored = sorted(t.read().collect(), key=lambda r: (-r.last_seen_at.timestamp(), r.platform, r.external_id))
        for verdict, limit in (("match", 20), (rng.choice(kinds[1:]), rng.choice((1, 10_000)))):
            want = [r for r in stored if r.verdict == verdict and verdict is not None][:limit]
            assert t.newest_rows(verdict, limit).collect() == want, (n, verdict, limit)
    m = t.newest()
    assert sum(stock[0] for of_part in m.shelves.values() for stock in of_part.values()) == t.read().count()
    chosen, since = t.shelves_of_newest(m, "match", 20)
    assert since is not None and {s for _, s in chosen} == {"match-0"} and len(chosen) <= 8
    assert len(t.newest_rows("match", 20).inputFiles()) <= 8 < len(t.read().inputFiles()) // 8
    assert len(t.shelves_of_newest(m, "match", 10_000)[0]) == sum(s.startswith("match-") for of_part in m.shelves.values() for s in of_part)


def landings(spark: SparkSession) -> tuple[list[DataFrame], list[DataFrame]]:
    node = lambda i, **more: {**LISTED, "id": str(i), **more}
    html = [
        [(1, page({"a": [node(1), node(2, price="900 $ / semaine")]})), (2, page({"a": node(1, title="Beau 4 1/2")}))], [(3, page({"a": [node(2, price=None)]})), (4, None)], [(5, page({"a": [node(3)]}))],
    ]
    texts = [[(1, 1, "https://x/marketplace/item/7/?r", "1 200 $\nCondo\nGatineau, QC")], [(2, 1, "https://x/marketplace/item/7/", "Condo neuf\nGatineau"), (2, 2, None, None)], []]
    return (
        [spark.createDataFrame([(i, None, h) for i, h in part], "page_id long, url string, html string") for part in html],
        [spark.createDataFrame(part, "page_id long, ord long, href string, text string") for part in texts],
    )


def test_streamed_pages_survive_kills_and_new_checkpoints(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch) -> None:  # noqa: ANN001
    """A job that dies before the table's commit, or between it and the stream's own, is run again; in the end the table
    is what upserts of the landings, one after the other, make of it."""
    details = spark.createDataFrame([("7", "Laveuse, sécheuse, frigo, poêle")], "external_id string, detail string")
    feeds = Feeds(f"{tmp_path}/pages", f"{tmp_path}/cards", details)
    t = ListingsTable(spark, f"{tmp_path}/t", 4)
    commit, calls = ListingsTable._commit, []

    def dying(self: ListingsTable, m) -> None:  # noqa: ANN001
        calls.append(m.version)
        if len(calls) == 2:
            raise OSError("killed before the commit")
        commit(self, m)
        if len(calls) == 4:
            raise OSError("killed after the commit")

    monkeypatch.setattr(ListingsTable, "_commit", dying)
    want, deaths = None, 0
    for html, texts in zip(*landings(spark), strict=True):
        html.coalesce(1).write.mode("append").parquet(feeds.pages)
        texts.coalesce(1).write.mode("append").parquet(feeds.cards)
        batch = html.withColumn("what", F.lit("page")).unionByName(texts.withColumn("what", F.lit("card")), allowMissingColumns=True)
        new = store.to_rows(judge(feeds.listings(batch)))
        want = store.first_snapshot(new, at(1)) if want is None else store.upsert(want, new, at(2))
        for _ in range(2):
            try:
                run_feeds(feeds, t, f"{tmp_path}/checkpoint").awaitTermination()
                break
            except StreamingQueryException as e:
                assert "killed" in str(e)
                deaths += 1
    assert deaths == 2 and calls == [0, 1, 1, 2] and t.version() == 2 and len(t.newest().ledger) == 1
    times = ("first_seen_at", "last_seen_at")
    plain = lambda df: sorted((tuple(r) for r in df.drop(*times).collect()), key=str)
    assert plain(t.read()) == plain(want)
    got = {(r.platform, r.external_id): r for r in t.read().collect()}
    assert set(got) == {("kijiji", "1"), ("kijiji", "2"), ("kijiji", "3"), ("facebook", "7")}
    assert got["kijiji", "2"].price_period == "week" and got["facebook", "7"].price_cad == 1200 and got["facebook", "7"].washer == "present"
    first = {k: r.first_seen_at for k, r in got.items()}
    run_feeds(feeds, t, f"{tmp_path}/another").awaitTermination()
    again = {(r.platform, r.external_id): r for r in t.read().collect()}
    assert {k: r.first_seen_at for k, r in again.items()} == first and len(t.newest().ledger) == 2


def test_runs_find_what_the_last_one_wrote(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    t = ListingsTable(spark, f"{tmp_path}/t", 4)
    source = lambda *found: [Source("kijiji", lambda: table(spark, list(found)).withColumn("seq", F.monotonically_increasing_id()))]
    first = run_into(t, source(IDEAL, {**IDEAL, "external_id": "2", "raw": '{"id": "1", "anything": true}', "seller_name": "Jean Tremblay"}), at(1))
    assert [tuple(r) for r in first.counters.collect()] == [("kijiji", 2, 2, 0, 2, 0, 0, None)]
    again = ListingsTable(spark, f"{tmp_path}/t")
    second = run_into(again, source({**IDEAL, "price_text": "1 395 $/mois", "title": "Prix réduit! 4 1/2"}), at(2))
    assert [tuple(r) for r in second.counters.collect()] == [("kijiji", 1, 0, 1, 1, 0, 0, None)] and not second.failures
    got = {r.external_id: r for r in again.read().collect()}
    assert (got["1"].price_cad, got["1"].first_seen_at, got["1"].last_seen_at) == (1395, datetime(2026, 8, 1), datetime(2026, 8, 2))
    assert got["1"].raw is None and json.loads(got["2"].raw) == {"id": "1", "anything": True}
    assert len(got["2"].seller_hash) == 64 and "Tremblay" not in str(tuple(got["2"]))
    assert store.new_matches(again.read(), at(2)).count() == 0 and again.newest().parts == 4


def test_raw_is_json_without_sellers(spark: SparkSession) -> None:
    nodes = [
        {"a": 1, "id": "1", "title": "t", "url": "u", "sellerName": "Jean"}, {"id": "2", "title": "t", "url": "u", "sellerName": {"name": "Jean"}, "posterName": "Ann"},
        {"id": "3", "title": "t", "url": "u", "more": [{"deep": {"userName": "Jean", "x": 1}}], "sellerName": ["Jean"]}, {"sellerName": "", "userName": "Jean", "id": "4", "name": "t", "price": float("nan")},
    ]
    found = pages.listings(spark.createDataFrame([(1, page({"l": nodes}))], "page_id long, html string"), "k", "h").collect()
    got = {r.external_id: (json.loads(r.raw, parse_constant=pytest.fail), r.seller_name) for r in found}
    assert got["1"] == ({"a": 1, "id": "1", "title": "t", "url": "u"}, "Jean") and got["2"] == ({"id": "2", "title": "t", "url": "u"}, None)
    assert got["3"][0]["more"] == [{"deep": {"x": 1}}] and got["4"] == ({"id": "4", "name": "t", "price": None}, "Jean")
    assert "Jean" not in str([g[0] for g in got.values()])


def test_rebuilt_listings_are_judged_as_collected_ones(spark: SparkSession) -> None:
    nodes = [{**LISTED, "id": str(i), **more} for i, more in enumerate(({}, {"price": "2 300 $"}, {"description": "Laveuse, sécheuse, frigo, poêle", "title": "4 1/2"}, {"title": "Chambre à louer"}))]
    found = pages.listings(spark.createDataFrame([(1, page({"l": nodes}))], "page_id long, html string"), "kijiji", "https://h").withColumn("seq", F.lit(0))
    stored = store.first_snapshot(store.to_rows(judge(found)), at(1))
    unlike = stored.unionByName(stored.where("external_id = '2'").withColumns({"external_id": F.lit("9"), "price_cad": F.lit(3900).cast("decimal(10,2)")}))
    c = Criteria(max_rent=Decimal(2500), exclude_rooms=False)
    got = {r.external_id: r for r in replay.compared(unlike, c, {"kijiji": replay.pages("https://h")}).collect()}
    want = {r.external_id: (r.before, r.after, r.gone, r.came) for r in store.replay(stored, judge(found, c)).collect()}
    assert {i: (r.before, r.after, r.gone, r.came) for i, r in got.items() if i != "9"} == want
    assert [i for i, r in got.items() if r.differs] == ["9"] and got["9"].by_columns == "reject"
    with pytest.raises(ValueError, match="no platform"):
        replay.rebuilt(stored, {})


def test_appended_history_equals_the_whole_window(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    """After several appends, some of them late, repeated or without prices, in one part or in many."""
    rng = random.Random(4)
    for parts in (1, 8):
        h, seen = PriceHistory(spark, f"{tmp_path}/h{parts}", parts), []
        assert h.history().count() == 0
        for day in (10, 11, 9, 12, 12, 3):
            new = [(rng.choice("kf"), str(rng.randrange(6)), datetime(2026, 8, day, rng.randrange(24)), rng.choice([None, Decimal(900), Decimal(950), Decimal(800)])) for _ in range(12)]
            new += [] if day < 12 else [("late", "1", datetime(2026, 8, 20 - len(seen) // 12), Decimal(700 + day))]
            h.append(spark.createDataFrame(new, OBSERVED))
            seen += new
            want = store.price_history(spark.createDataFrame(seen, OBSERVED).where("price_cad IS NOT NULL"))
            assert sorted(map(str, h.history().collect())) == sorted(map(str, want.collect()))
        assert h.append(spark.createDataFrame([("k", "1", datetime(2026, 9, 1), None)], OBSERVED)) == 5 and h.newest().rebased
        h.expire(keep=1, orphans_after=-1)
        assert sorted(map(str, h.history().collect())) == sorted(map(str, want.collect()))


def test_history_reads_no_log_for_what_is_on_time(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch) -> None:  # noqa: ANN001
    h = PriceHistory(spark, f"{tmp_path}/h", 4)
    row = lambda day, price: spark.createDataFrame([("k", "1", datetime(2026, 8, day), Decimal(price))], OBSERVED)
    h.append(row(1, 900))
    with monkeypatch.context() as m:
        m.setattr(PriceHistory, "_log", lambda *_: pytest.fail("the log was read"))
        h.append(row(2, 850))
    assert [(r.seen_at.day, r.previous, r["drop"]) for r in h.history().orderBy("seen_at").collect()] == [(1, None, None), (2, 900, 50)]


def test_any_order_of_responses_keeps_the_same_pages(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    rng = random.Random(7)
    rows = [(f"s{b}", p, f"u{b}-{p}", rng.choice([200, 200, 200, 200, 404, 429, 503]), rng.choice([None, 0, 3, 5, 8, 9])) for b in range(12) for p in range(1, 8)]
    rows += [rows[0], ("blocked", 1, "u", 429, 1), ("ends", 1, "u", 500, 0)]
    kind = "base string, page long, url string, status long, n_listings long"
    want = sorted(map(str, frontier.kept_responses(spark.createDataFrame(rows, kind)).collect()))
    for n, order in enumerate((rows, rows[::-1], rng.sample(rows, len(rows)))):
        t = PageCutoff(spark, f"{tmp_path}/t{n}", 4)
        assert t.kept().count() == 0
        for k in range(0, len(order), 23):
            version = t.append(spark.createDataFrame(order[k : k + 23], kind), ("s", k))
            assert t.append(spark.createDataFrame(order[k : k + 23], kind), ("s", k)) == version
        assert sorted(map(str, t.kept().collect())) == want
    late = PageCutoff(spark, f"{tmp_path}/late", 4)
    late.append(spark.createDataFrame([("a", 1, "a1", 200, 2), ("a", 2, "a2", 200, 2), ("a", 3, "a3", 200, 2)], kind))
    late.append(spark.createDataFrame([("a", 2, "a2 again", 404, 0), ("b", 1, "b1", 200, 1)], kind))
    assert {(r.url, r.added) for r in late.changes(0).collect()} == {("a2", False), ("a3", False), ("b1", True)}
    assert late.append(spark.createDataFrame([], kind)) == 1

"""Judging, extraction and the keyed table."""

from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

from pyspark.sql import SparkSession, functions as F

from rentmill.jobs import queries
from rentmill.operators import store, views
from rentmill.operators.criteria import LISTING, Criteria, judge
from rentmill.sources import cards, frontier, pages

IDEAL = {
    "platform": "kijiji", "external_id": "1", "url": "https://example.org/1", "title": "Beau 4 1/2 à Gatineau",
    "description": "Logement rénové, laveuse-sécheuse incluses, réfrigérateur et cuisinière fournis.", "price_text": "1 450 $/mois",
    "location_text": "Gatineau, QC J8Y 3X5", "latitude": None, "longitude": None, "attributes": {}, "posted_at": None, "seller_name": None, "raw": "{}",
}
CHANGES = [
    ({}, "match", []), ({"price_text": None}, "maybe", ["price_unknown"]), ({"price_text": "650 $/semaine"}, "reject", ["short_term_weekly", "over_budget"]),
    ({"price_text": "50 $ la nuit"}, "reject", ["short_term_dayly"]), ({"price_text": "100 $"}, "reject", ["price_implausible"]),
    ({"location_text": "Ottawa, ON"}, "reject", ["province_not_qc:on", "proximity_unverified"]), ({"location_text": None}, "reject", ["province_unknown", "proximity_unverified"]),
    ({"latitude": 46.8139, "longitude": -71.2080}, "reject", ["outside_radius"]), ({"location_text": "Montréal, QC"}, "maybe", ["proximity_unverified"]),
    ({"description": "Logement. Frigo et cuisinière."}, "maybe", ["washer_unknown", "dryer_unknown"]),
    ({"description": "Logement. Frigo, poêle.", "attributes": {"Laveuse/Sécheuse": "Oui"}}, "match", []),
    ({"title": "Chambre à louer"}, "reject", ["room_rental:room:chambre a louer"]), ({"title": "Superbe", "description": "Laveuse, sécheuse, frigo, poêle"}, "maybe", ["dwelling_type_unknown"]),
]


def table(spark: SparkSession, rows: list[dict]):  # noqa: ANN201
    names = [f.split()[0] for f in LISTING.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LISTING)


def test_judge(spark: SparkSession) -> None:
    rows = [{**IDEAL, **change, "external_id": str(i)} for i, (change, _, _) in enumerate(CHANGES)]
    got = {int(r.external_id): r for r in judge(table(spark, rows)).collect()}
    for i, (change, verdict, reasons) in enumerate(CHANGES):
        assert (got[i].verdict, got[i].reasons) == (verdict, reasons), change
    assert got[0].price.monthly == Decimal("1450.00") and got[0].place.province == "QC"
    waived = Criteria(require_washer=False, require_dryer=False, require_kitchen=False, exclude_rooms=False, allow_unknown_province=True)
    again = {int(r.external_id): r for r in judge(table(spark, rows), waived).collect()}
    assert again[9].verdict == "match" and again[11].verdict == "match" and again[6].reasons == ["province_unknown", "proximity_unverified"]


LISTED = {
    "id": "17", "title": "Beau", "description": "d", "price": {"amount": 145000}, "seoUrl": "/v/1", "sellerName": "Jean", "date": "2026-08-01T12:00:00Z",
    "location": {"name": "Gatineau", "coordinates": {"latitude": 45.4, "longitude": -75.7}, "zip": "J8Y 3X5"}, "attributes": [{"name": "a", "value": "x"}, {"name": "a", "value": None}, 3],
}


def page(data: object) -> str:
    return f'<html><SCRIPT x id="__NEXT_DATA__" y>{json.dumps(data)}</SCRIPT><script>no</script>'


def test_pages(spark: SparkSession) -> None:
    odd = [
        {"id": 1, "name": "n", "price": 1450.5}, {"id": 2, "title": "t", "price": 20000.0}, {"id": 3, "title": "t", "price": True}, {"id": 4, "title": 5, "priceLabel": "900 $", "price": ""},
        {"id": None, "adId": 5, "title": "t", "url": "u", "date": "yesterday"}, {"id": "", "title": "t", "url": None}, {"title": "no id", "url": "u"}, {"id": 6, "title": "t", "address": "Hull", "lat": 45, "lng": -75.5, "attributes": {"k": "v"}},
    ]
    rows = [(1, page({"a": [LISTED, {"b": odd}]})), (2, "<html></html>"), (3, page([LISTED])), (4, '<script id="__NEXT_DATA__">{bad</script>'), (5, None), (6, page({"r": [{**LISTED, "title": "first"}, {**LISTED, "title": "second"}]}))]
    found = pages.listings(spark.createDataFrame(rows, "page_id long, html string"), "kijiji", "https://h").collect()
    by = {(r.page_id, r.external_id): r for r in found}
    first = by[1, "17"]
    assert (first.price_text, first.location_text, first.latitude, first.longitude) == ("1450.00 $", "Gatineau J8Y 3X5", 45.4, -75.7)
    assert (first.url, first.seller_name, first.attributes, first.posted_at) == ("https://h/v/1", "Jean", {"a": None}, datetime(2026, 8, 1, 12))
    assert "Jean" not in first.raw and json.loads(first.raw)["id"] == "17"
    assert [by[1, str(i)].price_text for i in range(1, 5)] == ["1450.50 $", "20000.00 $", "1.00 $", "900 $"]
    assert by[1, "4"].title is None and by[1, "5"].posted_at is None and by[1, "5"].url == "u"
    assert (by[1, "6"].location_text, by[1, "6"].latitude, by[1, "6"].longitude, by[1, "6"].attributes) == ("Hull", 45.0, -75.5, {"k": "v"})
    assert {p for p, _ in by} == {1, 6} and len(found) == 9
    last = {r.external_id: r for r in pages.latest(pages.listings(spark.createDataFrame(rows, "page_id long, html string"), "kijiji", "h")).collect()}
    assert last["17"].page_id == 6 and last["17"].title == "first"


def test_cards(spark: SparkSession) -> None:
    texts = ["CA$1,450\n4 1/2 rénové, laveuse sécheuse\nGatineau, QC", "3 900 $\nCondo\nGatineau", "1200 $\nCondo\nOttawa, ON", "Publié il y a 3 jours\n \n900 $ / semaine\nStudio", "just one line"]
    rows = [(1, i, f"https://x/marketplace/item/{i}/?r=1", t) for i, t in enumerate(texts)] + [(1, 9, "https://x/marketplace/item/0/", "short"), (1, 10, "/other", "x")]
    found = cards.worth_opening(cards.to_listings(cards.harvest(spark.createDataFrame(rows, "page_id long, ord long, href string, text string")), "fb"))
    details = spark.createDataFrame([("0", "D" * 9000), ("1", "E"), ("2", "F"), ("4", "")], "external_id string, detail string")
    got = {r.external_id: r for r in found.collect()}
    assert [(got[str(i)].price_text, got[str(i)].title, got[str(i)].location_text) for i in range(5)] == [
        ("CA$1,450", "4 1/2 rénové, laveuse sécheuse", "Gatineau, QC"), ("3 900 $", "Condo", "Gatineau"), ("1200 $", "Condo", "Ottawa, ON"), ("900 $ / semaine", "Studio", None), (None, "just one line", None),
    ]
    assert [got[str(i)].worth_opening for i in range(5)] == [True, False, False, False, True] and got["0"].url == "https://x/marketplace/item/0/"
    full = {r.external_id: r for r in cards.enrich(found, details).collect()}
    assert len(full) == 5 and full["0"].description == "D" * 9000 and len(json.loads(full["0"].raw)["detail_text"]) == 8000
    assert full["1"].description is None and full["4"].description is None


def test_only_the_last_cards_are_parsed(spark: SparkSession) -> None:
    """Of an item's cards that of its last page counts, whatever lands first, and it is chosen before texts are parsed."""
    rows = [(2, 1, "/marketplace/item/1/?r", "900 $\nold"), (3, 2, "/marketplace/item/1/", "9 $\nshort"), (3, 3, "/marketplace/item/1/?s", " 800 $\nlonger "),
            (3, 4, "/marketplace/item/1/?t", "700 $\nlonger"), (4, 5, "/marketplace/item/1/", " "), (1, 6, "/marketplace/item/2/", "x"), (5, 7, "/other", "y"), (None, 8, "/marketplace/item/2/", "zz")]
    anchors = spark.createDataFrame(rows, "page_id long, ord long, href string, text string")
    got = sorted(tuple(r) for r in cards.latest(anchors).collect())
    assert got == [(1, "2", "/marketplace/item/2/", "x"), (3, "1", "/marketplace/item/1/", "800 $\nlonger")]
    assert got == sorted(tuple(r) for r in store.last_by(cards.harvest(anchors), ("id",), ["page_id"]).collect())


def test_cards_are_read_once(spark: SparkSession) -> None:
    """Neither the details nor a pushed-down filter read the anchors once more, and only the last cards are parsed."""
    plan = queries.QUERIES["card_listings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    below = plan[plan.index("RepartitionByExpression"):]
    above = plan[: plan.index("Aggregate")]
    assert "regexp" not in below and plan.count("Aggregate") == 1 and "location_text" in above


def test_replay_keeps_what_it_reads(spark: SparkSession) -> None:
    """No hash of a seller is made for a replay, and nothing else that it doesn't read; its rows are those of all columns."""
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plan = made(queries.QUERIES["replay_transitions"](spark, "/root/testdata/sf0.001"))
    assert not any(word in plan for word in ("sha2", "postal_prefix#", "unit_type#", "Vendeur"))
    narrow = queries._stored(spark, "/root/testdata/sf0.001", store.REPLAYED)
    assert narrow.exceptAll(queries._stored(spark, "/root/testdata/sf0.001").select(narrow.columns)).count() == 0


def test_frontier(spark: SparkSession) -> None:
    got = frontier.frontier(spark.createDataFrame([("https://h/b-x/c1/",)], "base string"), 3).orderBy("page").collect()
    assert [r.url for r in got] == ["https://h/b-x/c1/", "https://h/b-x/page-2/c1", "https://h/b-x/page-3/c1"]
    rows = [("a", 1, 200, 3), ("a", 2, 429, 0), ("a", 3, 200, 1), ("a", 4, 404, 0), ("a", 5, 200, 9), ("b", 1, 200, 2), ("b", 2, 200, 0), ("b", 3, 200, 4)]
    responses = spark.createDataFrame([(*r, f"{r[0]}{r[1]}") for r in rows], "base string, page int, status int, n_listings int, url string")
    kept = {(r.base, r.page): r.stop_reason for r in frontier.kept_responses(responses).collect()}
    assert kept == {("a", 1): "http 404 on a4", ("a", 3): "http 404 on a4", ("b", 1): None}


def test_upsert(spark: SparkSession) -> None:
    at = lambda day: F.lit(f"2026-08-0{day} 00:00:00").cast("timestamp")
    batch = lambda *rows: spark.createDataFrame(rows, "platform string, external_id string, title string, verdict string, price_cad decimal(10,2), price_period string, seq int")
    first = batch(("k", "1", "a", "match", Decimal(900), "month", 1), ("k", "2", "b", "reject", None, None, 2), ("f", "1", "c", "maybe", Decimal(5), "week", 3))
    stored = store.first_snapshot(first, at(1))
    second = batch(("k", "1", "a2", "maybe", None, None, 1), ("k", "3", "x", "match", Decimal(7), "month", 2), ("k", "3", "y", "match", None, None, 3))
    after = {(r.platform, r.external_id): r for r in store.upsert(stored, second, at(2)).collect()}
    assert len(after) == 4 and after["k", "1"].title == "a2" and after["k", "1"].price_cad == 900 and after["k", "1"].price_period == "month"
    assert after["k", "1"].first_seen_at == datetime(2026, 8, 1) and after["k", "1"].last_seen_at == datetime(2026, 8, 2) and after["f", "1"].last_seen_at == datetime(2026, 8, 1)
    assert (after["k", "3"].title, after["k", "3"].price_cad, after["k", "3"].first_seen_at) == ("y", Decimal(7), datetime(2026, 8, 2))
    counts = store.run_counters(stored, second).first()
    assert (counts.seen, counts.new, counts.updated, counts.match, counts.maybe, counts.reject) == (3, 1, 2, 2, 1, 0)
    once = store.upsert(stored, second, at(2))
    assert sorted(map(str, store.upsert(once, second, at(2)).collect())) == sorted(map(str, once.collect()))
    shown = views.display(once.withColumns({"url": F.lit(None).cast("string"), "rooms": F.lit(4.5), "city": F.lit(None).cast("string"), "washer": F.lit("present"), "dryer": F.lit(None).cast("string"), "verdict_reasons": F.array(F.lit("r1"), F.lit("r2"))}))
    row = shown.where("external_id = '3'").first()
    assert (row.price, row.rooms, row.city, row.laundry, row.why) == ("$7", "4½", "?", "w:present d:?", "")
    assert (row.title, row.url) == ("y", "")
    hashes = spark.createDataFrame([("Jean",), ("Jean",), (None,)], "n string").select(store.seller_hash(F.col("n"))).collect()
    assert hashes[0][0] == hashes[1][0] and len(hashes[0][0]) == 64 and hashes[2][0] is None


def test_stream_of_batches(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    from rentmill.operators.table import ListingsTable
    from rentmill.streaming import upserts

    landing, out = f"{tmp_path}/landing", ListingsTable(spark, f"{tmp_path}/table", 4)
    for seq, price in ((1, "1 450 $/mois"), (2, "1 500 $/mois")):
        table(spark, [{**IDEAL, "price_text": price}, {**IDEAL, "external_id": f"n{seq}"}]).withColumn("seq", F.lit(seq)).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing)
        upserts.run(stream, out, f"{tmp_path}/checkpoint").awaitTermination(120)
    got = {r.external_id: r for r in out.read().collect()}
    assert set(got) == {"1", "n1", "n2"} and got["1"].price_cad == 1500 and got["1"].first_seen_at < got["1"].last_seen_at

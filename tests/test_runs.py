"""Runs over several sources, their reports, and inputs that must not stop a job."""

from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

from pyspark.sql import SparkSession, functions as F

from rentmill.functions.appliances import flags
from rentmill.jobs.run import Source, run
from rentmill.operators import store
from rentmill.operators.criteria import APPLIANCES, Criteria, judge
from rentmill.operators.table import ListingsTable
from rentmill.sources import frontier, landed, pages
from rentmill.streaming import upserts

from .test_jobs import IDEAL, page, table


def test_hostile_pages(spark: SparkSession) -> None:
    """Deep nesting, half surrogate pairs and repeated keys are no reason to fail."""
    node = '{"id":"x","title":"\\ud83d half","url":"u"}'
    texts = ["[" * 200_000, '{"a":' * 100_000 + "1" + "}" * 100_000, f'{{"a":[{node}]}}', f'{{"a":{node},"a":1}}', "NaN", f"[{node}]", '{"id":"y","title":"\\ud83d\\ude00","url":"u"}']
    rows = [(i, f'<script id="__NEXT_DATA__" >{t}</script>') for i, t in enumerate(texts)]
    found = {(r.page_id, r.external_id): r.title for r in pages.listings(spark.createDataFrame(rows, "page_id long, html string"), "k", "h").collect()}
    assert found == {(2, "x"): "? half", (3, "x"): "? half", (6, "y"): "😀"}


def test_order_of_visits() -> None:
    """An object comes before what it contains, and the last of what it contains first."""
    node = lambda name, **more: {"id": name, "title": "t", "url": "u", **more}
    data = {"list": [node("a"), node("b", inner=node("c"), more=[node("d"), node("e")])], "last": {"deep": [[node("f")]]}}
    assert [n["id"] for n in pages.listing_nodes(json.dumps(data))] == ["f", "b", "e", "d", "c", "a"]
    assert pages.listing_nodes(json.dumps([node("a")])) == [] and pages.listing_nodes("{bad") == []


def test_one_failing_source_does_not_sink_the_other(spark: SparkSession) -> None:
    at = lambda day: F.lit(f"2026-08-0{day} 00:00:00").cast("timestamp")
    good = lambda *rows: lambda: table(spark, list(rows)).withColumn("seq", F.monotonically_increasing_id())
    broken = lambda: good(IDEAL)().withColumn("title", F.raise_error(F.lit("moved the goalposts")).cast("string"))
    first = run(spark, [Source("kijiji", good(IDEAL, {**IDEAL, "external_id": "2", "title": "Chambre à louer"}), lambda: "http 500 on u")], None, at(1))
    assert {(r.external_id, r.verdict) for r in first.table.collect()} == {("1", "match"), ("2", "reject")}
    seen = first.counters.first()
    assert (seen.seen, seen.new, seen.updated, seen.match, seen.reject, seen.stopped_early) == (2, 2, 0, 1, 1, "http 500 on u")
    assert store.summary(first.counters).first().summary.endswith("| STOPPED EARLY (http 500 on u)")
    sources = [Source("other", broken), Source("facebook", good({**IDEAL, "platform": "facebook", "price_text": None})), Source("empty", good())]
    second = run(spark, sources, first.table, at(2))
    assert set(second.failures) == {"other"} and "moved the goalposts" in second.failures["other"] and "Traceback" in second.failures["other"]
    assert {(r.platform, r.external_id) for r in second.table.collect()} == {("kijiji", "1"), ("kijiji", "2"), ("facebook", "1")}
    report = json.loads(store.report_document(second.counters, at(2)).first().report)
    assert report["ran_at"] == "2026-08-02T00:00:00Z" and [r["platform"] for r in report["results"]] == ["empty", "facebook"]
    assert report["results"][0] == {"platform": "empty", "seen": 0, "new": 0, "updated": 0, "by_verdict": {"match": 0, "maybe": 0, "reject": 0}, "stopped_early": None}
    def lost() -> str | None:
        raise FileNotFoundError("no log")

    third = run(spark, [Source("kijiji", good(IDEAL), lost)], second.table, at(3))
    assert third.table.count() == 3 and "no log" in third.failures["kijiji"] and "Traceback" in third.failures["kijiji"]
    assert [tuple(r) for r in third.counters.collect()] == [("kijiji", 1, 0, 1, 1, 0, 0, "unknown: no log")]
    nothing = run(spark, [Source("other", broken)], first.table, at(3))
    assert nothing.batch is None and nothing.counters.count() == 0 and nothing.table is first.table


def test_stopped_early(spark: SparkSession) -> None:
    rows = [("a", 1, 404, 0), ("b", 1, 200, 2), ("b", 2, 500, 0), ("c", 1, 429, 0), ("c", 2, 200, 0), ("c", 3, 500, 0)]
    responses = spark.createDataFrame([(*r, f"{r[0]}{r[1]}") for r in rows], "base string, page int, status int, n_listings int, url string")
    assert frontier.stopped_early(responses) == "http 500 on b2"
    assert frontier.stopped_early(responses.where("base = 'c'")) is None


def test_stored_rows_are_judged_again_without_parsing(spark: SparkSession) -> None:
    changes = [{}, {"price_text": "2 300 $"}, {"description": "Logement. Frigo et cuisinière."}, {"title": "Chambre à louer"}, {"location_text": None}]
    listings = table(spark, [{**IDEAL, **c, "external_id": str(i)} for i, c in enumerate(changes)]).withColumn("seq", F.lit(0))
    stored = store.first_snapshot(store.to_rows(judge(listings)), F.lit(datetime(2026, 8, 1)))
    c = Criteria(max_rent=Decimal(2500), require_washer=False, require_dryer=False, exclude_rooms=False, allow_unknown_province=True)
    want = {r.external_id: (r.before, r.after, r.gone, r.came) for r in store.replay(stored, judge(listings, c)).collect()}
    got = {r.external_id: (r.before, r.after, r.gone, r.came) for r in store.replay_stored(stored, c).collect()}
    assert got == want and got["1"][:2] == ("reject", "match") and got["2"][:2] == ("maybe", "match")


def test_flags(spark: SparkSession) -> None:
    rows = [("present",) * 5, ("present", "absent", "present", "unknown", "absent")]
    found = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in APPLIANCES)).select(*(F.struct(F.col(n).alias("status")).alias(n) for n in APPLIANCES))
    got = found.select(*(c.alias(n) for n, c in flags({n: F.col(n) for n in APPLIANCES}).items())).collect()
    assert (got[0].has_laundry, got[0].has_kitchen, got[1].has_laundry, got[1].has_kitchen, got[1].washer_included, got[1].dryer_included) == (True, True, False, False, True, False)


def test_landed_files(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "a.json").write_text(json.dumps({"page_id": 1, "html": page({"a": []})}) + "\nnot json\n")
    rows = landed.read(spark, str(tmp_path), landed.PAGES, "json").collect()
    assert len(rows) == 2 and {r.page_id for r in rows} == {1, None} and rows[0].url is None
    assert landed.read(spark, str(tmp_path), landed.PAGES, "json", stream=True).isStreaming


def test_old_versions_go(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    kept = ListingsTable(spark, str(tmp_path), 4)
    write = upserts.writer(kept, keep=1, stream="s")
    for n in range(4):
        batch = table(spark, [{**IDEAL, "external_id": str(n)}]).withColumns({"seq": F.lit(n), "landed_at": F.lit(datetime(2026, 8, 1 + n))})
        write(batch, n)
    write(batch, 3)
    assert [p.name[-6:] for p in (tmp_path / "manifests").glob("*.json")] == ["3.json"] and kept.newest().ledger == {"s": 3}
    assert len(list(tmp_path.glob("data/*/part=*"))) == len(kept.newest().folders)
    got = {r.external_id: r.first_seen_at for r in kept.read().collect()}
    assert got == {str(n): datetime(2026, 8, 1 + n) for n in range(4)}


def test_values_are_given_unless_empty(spark: SparkSession) -> None:
    texts = ["null", '""', "[]", "{}", "0", "false", '"[]"', '"{}"', '"null"', "[null]", "[[]]", '{"a":{}}', '"x"', "1.5", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("v", F.parse_json("t"))
    got = [r.g for r in rows.orderBy("i").select(pages.given(F.col("v")).alias("g")).collect()]
    assert got == [False] * 4 + [True] * 10 + [False]


def test_only_the_last_nodes_become_listings(spark: SparkSession) -> None:
    nodes = [{"id": "7", "title": f"t{i}", "price": i} for i in range(3)] + [{"id": "", "listingId": 8, "title": "u", "url": "/u"}, {"id": None, "title": "v", "url": "/v"}]
    html = '<script id="__NEXT_DATA__">' + json.dumps({"l": nodes}) + "</script>"
    rows = spark.createDataFrame([(1, html), (2, html)], "page_id long, html string")
    want = pages.latest(pages.listings(rows, "k", "https://h"))
    got = pages.latest_listings(rows, "k", "https://h")
    assert sorted(map(str, got.drop("attributes").collect())) == sorted(map(str, want.drop("attributes").collect())) and got.count() == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" in plan and "price_text" not in plan[plan.index("Aggregate"):]

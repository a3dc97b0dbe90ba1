"""The keyed table of listings: deduplication, idempotent upsert, run counters, price history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .criteria import APPLIANCES, Criteria, judge_parsed

KEY = ("platform", "external_id")
VERDICTS = ("match", "maybe", "reject")
#: What ``collapse`` counts beside a key's row.
BOOK = ("n", *(f"n_{v}" for v in VERDICTS))
SELLER_FIELDS = ("sellerName", "posterName", "userName")


def last_by(df: DataFrame, key: tuple[str, ...], order: list[str]) -> DataFrame:
    """Of rows with equal key the last by ``order``. A map-side combined maximum: no key is sorted in one task."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(best).select(*key, "_last.*").select(df.columns)


def seller_hash(name: Column) -> Column:
    return F.when(F.length(name) > 0, F.sha2(name.cast("binary"), 256))


def to_rows(judged: DataFrame, *more: str) -> DataFrame:
    """Judged listings (with ``seq``, their order in the batch) as rows of the stored table, without times, and ``more``
    of their columns. An empty payload is stored as null."""
    return judged.select(
        *KEY, "url", "title", "description",
        F.col("price.monthly").try_cast("decimal(10,2)").alias("price_cad"), F.col("price.period").alias("price_period"),
        "place.city", "place.province", "place.postal_prefix", "latitude", "longitude", "place.distance_km",
        "dwelling.rooms", "dwelling.bedrooms", "dwelling.unit_type", F.col("dwelling.is_room").alias("is_room_rental"),
        *(F.col(f"{n}.status").alias(n) for n in ("washer", "dryer", "fridge", "stove", "dishwasher")),
        "verdict", F.col("reasons").alias("verdict_reasons"), "posted_at",
        seller_hash(F.col("seller_name")).alias("seller_hash"), F.nullif(F.col("raw"), F.lit("{}")).alias("raw"), "seq", *more,
    )


def collapse(batch: DataFrame) -> DataFrame:
    """One row a key: the last by ``seq``, with the last price that isn't null, ``n``, the rows it stands for, and ``n_``
    with each verdict, those of them that have it.

    One aggregate combined map-side, so a key that is repeated without bound costs no sort."""
    price = F.struct("price_cad", "price_period")
    others = [c for c in batch.columns if c not in (*KEY, "price_cad", "price_period", "seq")]
    done = batch.groupBy(*KEY).agg(
        F.max_by(F.struct(*others), F.col("seq")).alias("row"),
        F.max_by(F.when(F.col("price_cad").isNotNull(), price), F.when(F.col("price_cad").isNotNull(), F.col("seq"))).alias("price"),
        F.count("*").alias("n"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS),
    )
    return done.select(*KEY, "row.*", "price.price_cad", "price.price_period", *BOOK)


def merge(stored: DataFrame, batch: DataFrame, run_at: Column) -> DataFrame:
    """The table after a run: new keys are added, known ones overwritten except first_seen_at, and except the price
    where the batch has none; others stay. A full outer equi-join on the key. Beside the columns of ``stored`` a row has
    the ``BOOK`` columns, null unless the batch has its key, and ``fresh``, whether the key is new: what the counters of
    the run are sums of."""
    t, b = stored.alias("t"), collapse(batch).alias("b")
    rows = t.withColumn("_known", F.lit(True)).alias("t").join(b, list(KEY), "full_outer")
    new = F.col("b.n").isNotNull()
    priced = F.col("b.price_cad").isNotNull()
    out = []
    for c in stored.columns:
        if c in KEY:
            value = F.col(c)
        elif c == "first_seen_at":
            value = F.coalesce("t.first_seen_at", run_at)
        elif c == "last_seen_at":
            value = F.when(new, run_at).otherwise(F.col("t.last_seen_at"))
        elif c in ("price_cad", "price_period"):
            value = F.when(new & priced, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}"))
        else:
            value = F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}"))
        out.append(value.alias(c))
    return rows.select(*out, *(F.col(f"b.{c}").alias(c) for c in BOOK), F.col("t._known").isNull().alias("fresh"))


def upsert(stored: DataFrame, batch: DataFrame, run_at: Column) -> DataFrame:
    """``merge`` without what is kept for the counters."""
    return merge(stored, batch, run_at).select(stored.columns)


def first_merge(batch: DataFrame, run_at: Column) -> DataFrame:
    """``merge`` into a table that doesn't exist yet."""
    rows = collapse(batch).withColumns({"first_seen_at": run_at, "last_seen_at": run_at, "fresh": F.lit(True)})
    return rows.select(*(c for c in rows.columns if c not in (*BOOK, "fresh")), *BOOK, "fresh")


def first_snapshot(batch: DataFrame, run_at: Column) -> DataFrame:
    return first_merge(batch, run_at).drop(*BOOK, "fresh")


COUNTERS = f"platform string, seen long, new long, updated long, {', '.join(f'{v} long' for v in VERDICTS)}"


def counting(platforms: Sequence[str]) -> list[Column]:
    """Sums over the rows of ``merge`` that ``counted`` turns into counters, to be observed while these are written.
    Platforms are few."""
    out = []
    for i, p in enumerate(platforms):
        mine = F.col("platform") == p
        out += [F.coalesce(F.sum(F.when(mine, F.col(c))), F.lit(0)).alias(f"{c}_{i}") for c in BOOK]
        out.append(F.count_if(mine & F.col("fresh")).alias(f"fresh_{i}"))
    return out or [F.count("*").alias("rows")]


def counted(platforms: Sequence[str], seen: dict[str, int]) -> list[tuple]:
    """Rows of ``COUNTERS`` of the platforms that the batch has."""
    rows = [(p, *(seen[f"{c}_{i}"] for c in (*BOOK, "fresh"))) for i, p in enumerate(platforms)]
    return [(p, n, fresh, n - fresh, *verdicts) for p, n, *verdicts, fresh in rows if n]


def run_counters(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Per platform: rows seen, new keys, updated, and rows by verdict."""
    fresh = batch.select(*KEY).distinct().join(stored.select(*KEY), list(KEY), "left_anti").groupBy("platform").agg(F.count("*").alias("new"))
    seen = batch.groupBy("platform").agg(
        F.count("*").alias("seen"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS)
    )
    new = F.coalesce("new", F.lit(0))
    return seen.join(fresh, "platform", "left").select("platform", "seen", new.alias("new"), (F.col("seen") - new).alias("updated"), *VERDICTS)


def with_stops(counters: DataFrame, ran: DataFrame) -> DataFrame:
    """Counters of each platform that ``ran`` (platform, stopped_early), zero where it had no listing, and of those
    that only listings name."""
    rows = ran.groupBy("platform").agg(F.max("stopped_early").alias("stopped_early")).join(counters, "platform", "full_outer")
    return rows.select("platform", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("seen", "new", "updated", *VERDICTS)), "stopped_early")


def summary(counters: DataFrame) -> DataFrame:
    parts = [F.concat(F.col("platform"), F.lit(": "), F.col("seen"), F.lit(" seen"))]
    parts += [F.concat_ws(" ", F.col(c), F.lit(c)) for c in ("new", "updated", *VERDICTS)]
    if "stopped_early" in counters.columns:
        parts.append(F.when(F.length("stopped_early") > 0, F.concat(F.lit("STOPPED EARLY ("), "stopped_early", F.lit(")"))))
    return counters.select("platform", F.concat_ws(" | ", *parts).alias("summary"))


def rows_written(counters: DataFrame) -> DataFrame:
    return counters.select("platform", (F.col("new") + F.col("updated")).alias("written"))


def run_report(counters: DataFrame, run_at: Column) -> DataFrame:
    """One JSON text a platform."""
    verdicts = F.struct(*VERDICTS).alias("by_verdict")
    body = F.to_json(F.struct(F.date_format(run_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ran_at"), "platform", "seen", "new", "updated", verdicts))
    return counters.select("platform", body.alias("report"))


def report_document(counters: DataFrame, run_at: Column) -> DataFrame:
    """The report of a run: one JSON text with ``ran_at`` and the results of all platforms (a handful of rows)."""
    results = F.struct("platform", "seen", "new", "updated", F.struct(*VERDICTS).alias("by_verdict"), "stopped_early")
    rows = counters.agg(F.array_sort(F.collect_list(results)).alias("results"))
    ran_at = F.date_format(run_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ran_at")
    return rows.select(F.to_json(F.struct(ran_at, "results"), {"ignoreNullFields": "false"}).alias("report"))


def new_matches(stored: DataFrame, run_at: Column) -> DataFrame:
    return stored.where((F.col("first_seen_at") == run_at) & (F.col("verdict") == "match"))


def price_history(observations: DataFrame) -> DataFrame:
    """``observations`` (key, seen_at, price_cad) with the price before and whether it dropped."""
    w = W.partitionBy(*KEY).orderBy("seen_at", "price_cad")
    rows = observations.withColumn("previous", F.lag("price_cad").over(w))
    return rows.withColumn("drop", F.when(F.col("price_cad") < F.col("previous"), F.col("previous") - F.col("price_cad")))


def reason_codes(reasons: Column) -> Column:
    """Reasons without the phrases behind them."""
    return F.transform(reasons, lambda r: F.substring_index(r, ":", 1))


def replay(stored: DataFrame, judged: DataFrame) -> DataFrame:
    """Verdict changes between the stored rows and the same rows judged under other criteria (key, verdict,
    reasons): the reasons that went and came, by code."""
    before = stored.select(*KEY, F.col("verdict").alias("before"), reason_codes(F.col("verdict_reasons")).alias("old"))
    rows = before.join(judged.select(*KEY, F.col("verdict").alias("after"), reason_codes(F.col("reasons")).alias("now")), list(KEY))
    return rows.select(*KEY, "before", "after", F.array_except("old", "now").alias("gone"), F.array_except("now", "old").alias("came"))


def as_parsed(stored: DataFrame) -> DataFrame:
    """Stored rows with the parts that judging asks for, made of their own parsed columns. The phrases behind reasons
    aren't stored."""
    price = F.struct(F.col("price_cad").alias("amount"), F.col("price_period").alias("period"), F.col("price_cad").alias("monthly"))
    none = F.lit("")
    return stored.withColumns({
        "price": F.when(F.col("price_cad").isNotNull(), price),
        "place": F.struct("province", "city", "distance_km"),
        "dwelling": F.struct(F.col("is_room_rental").alias("is_room"), none.alias("evidence")),
        **{n: F.struct(F.col(n).alias("status"), none.alias("evidence")) for n in APPLIANCES},
    })


#: The columns of stored rows that ``replay_stored`` reads.
REPLAYED = (*KEY, "verdict", "verdict_reasons", "price_cad", "price_period", "province", "city", "distance_km", "is_room_rental", *APPLIANCES)


def replay_stored(stored: DataFrame, c: Criteria) -> DataFrame:
    """``replay`` of stored rows by their own parsed columns: nothing is parsed again and nothing is joined. Reasons are
    compared by code. Only ``REPLAYED`` columns are asked for."""
    rows = as_parsed(stored).withColumnsRenamed({"verdict": "before", "verdict_reasons": "_before"})
    rows = judge_parsed(rows, c).withColumns({"old": reason_codes(F.col("_before")), "now": reason_codes(F.col("reasons"))})
    return rows.select(*KEY, "before", F.col("verdict").alias("after"), F.array_except("old", "now").alias("gone"), F.array_except("now", "old").alias("came"))


def transitions(changes: DataFrame) -> DataFrame:
    return changes.groupBy("before", "after").agg(F.count("*").alias("n"))

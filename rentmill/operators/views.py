"""What is shown of the stored table: the newest by verdict, display columns, an inspection dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def newest(stored: DataFrame, verdict: str = "match", limit: int = 50) -> DataFrame:
    """A top-k report: per-partition heaps, no full sort."""
    order = [F.col("last_seen_at").desc(), F.col("platform"), F.col("external_id")]
    return stored.where(F.col("verdict") == verdict).orderBy(*order).limit(limit)


def shown_price(price: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(price, 0)), F.lit("$?"))


def shown_rooms(rooms: Column) -> Column:
    return F.when(rooms > 0, F.concat(F.floor(rooms).cast("string"), F.lit("½"))).otherwise("?")


def display(stored: DataFrame) -> DataFrame:
    laundry = F.concat(F.lit("w:"), F.coalesce("washer", F.lit("?")), F.lit(" d:"), F.coalesce("dryer", F.lit("?")))
    why = F.when(F.col("verdict") != "match", F.array_join("verdict_reasons", ", ")).otherwise("")
    return stored.select(
        "platform", "external_id", "verdict", shown_price(F.col("price_cad")).alias("price"), shown_rooms(F.col("rooms")).alias("rooms"),
        F.coalesce("city", F.lit("?")).alias("city"), laundry.alias("laundry"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "url")), why.alias("why"),
    )


def inspect(listings: DataFrame, limit: int = 25, chars: int = 500) -> DataFrame:
    """The first listings by key, their descriptions cut, with the number of all listings. Nothing is stored."""
    total = listings.agg(F.count("*").alias("total"))
    first = listings.orderBy("platform", "external_id").limit(limit)
    cut = F.substring(F.coalesce("description", F.lit("")), 1, chars).alias("description")
    return first.select("platform", "external_id", "title", "price_text", "location_text", cut).crossJoin(F.broadcast(total))

"""Listings from the short texts of a grid of cards, and from the details of those worth opening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import locate
from ..functions.price import is_short_term, parse_price
from ..functions.text import fold, let
from ..operators.criteria import Criteria

#: An item's id in its link, lines that are no content, and the longest location line.
ITEM_ID = r"/marketplace/item/(\d+)"
NOISE = r"^(publie|posted|location|listed|sponsorise|sponsored|nouveau|new)\b"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LONGEST_LOCATION, DETAIL_CHARS = 48, 8000


def best_cards(anchors: DataFrame, by: list[str], first: list[str]) -> DataFrame:
    """Of ``anchors`` (page_id, ord, href, text) that link to an item and say something, the best one of each ``by``: the
    last by ``first``, then the longest text, the first on ties. What counts is told inside the aggregate, and ids come
    out of it: filters would be pushed below the exchange that deals the anchors to tasks, and texts made once more there."""
    rows = anchors.select(
        "page_id", F.regexp_extract("href", ITEM_ID, 1).alias("id"), F.split_part("href", F.lit("?"), F.lit(1)).alias("href"),
        F.trim(F.regexp_replace("text", r"^[\s]+|[\s]+$", "")).alias("text"), "ord",
    )
    counts = (F.col("id") != "") & (F.length("text") > 0)
    best = F.max_by(F.struct("page_id", "id", "href", "text"), F.when(counts, F.struct(*first, F.length("text"), -F.col("ord")))).alias("card")
    return rows.groupBy(*by).agg(best).where(F.col("card").isNotNull()).select("card.*")


def harvest(anchors: DataFrame) -> DataFrame:
    """One card an item and page of ``anchors`` (page_id, ord, href, text): the longest text, the first on ties."""
    return best_cards(anchors, ["page_id", "id"], [])


def latest(anchors: DataFrame) -> DataFrame:
    """Of the cards that ``harvest`` has of an item, that of its last page. Most items are on many pages, and only one card
    of each is parsed."""
    return best_cards(anchors, ["id"], ["page_id"])


def card_parts(text: Column) -> Column:
    """Struct of price_text, title, location_text of a card's lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda s: (s != "") & ~fold(s).rlike(NOISE))

    def split(s: Column) -> Column:
        rest = F.filter(s.lines, lambda x: ~x.eqNullSafe(s.price))
        return F.struct(s.price.alias("price"), rest.alias("rest"), F.get(rest, F.size(rest) - 1).alias("last"))

    def parts(s: Column) -> Column:
        placed = (F.size(s.rest) > 1) & (F.length(s.last) <= LONGEST_LOCATION)
        titles = F.when(placed, F.slice(s.rest, F.lit(1), F.greatest(F.size(s.rest) - 1, F.lit(0)))).otherwise(s.rest)
        longest = F.array_max(F.transform(titles, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("s"))))
        return F.struct(s.price.alias("price_text"), longest.s.alias("title"), F.when(placed, s.last).alias("location_text"))

    priced = lambda ls: F.struct(ls.alias("lines"), F.get(F.filter(ls, lambda x: F.contains(x, F.lit("$"))), F.lit(0)).alias("price"))
    return let(let(let(lines, priced), split), parts)


def to_listings(cards: DataFrame, platform: str) -> DataFrame:
    """Cards (page_id, id, href, text) as listings, with the page each was seen on."""
    rows = cards.where(F.length("id") > 0).withColumn("parts", card_parts(F.col("text")))
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        F.lit(platform).alias("platform"), F.col("id").alias("external_id"), F.col("href").alias("url"), "parts.title",
        null("string").alias("description"), "parts.price_text", "parts.location_text", null("double").alias("latitude"),
        null("double").alias("longitude"), F.create_map().cast("map<string,string>").alias("attributes"),
        null("timestamp").alias("posted_at"), null("string").alias("seller_name"),
        F.to_json(F.struct(F.col("text").alias("card_text"))).alias("raw"), "page_id",
    )


def worth_opening(listings: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    """``listings`` with ``worth_opening``: not over budget, not short-term, and not known to be elsewhere."""
    price = parse_price([F.col("price_text"), F.col("title")])
    rows = listings.withColumn("_price", price)
    null = F.lit(None).cast("double")
    rows = rows.withColumn("_province", locate(F.col("location_text"), null, null, c.centre).province)
    costly = F.coalesce((F.col("_price.monthly") > F.lit(c.max_rent)) | is_short_term(F.col("_price")), F.lit(False))
    elsewhere = F.coalesce((F.length("location_text") > 0) & (F.col("_province") != "QC"), F.lit(False))
    return rows.withColumn("worth_opening", ~costly & ~elsewhere).drop("_price", "_province")


def enrich(listings: DataFrame, details: DataFrame) -> DataFrame:
    """``listings`` (with worth_opening) with the description from ``details`` (external_id, detail). Only details of
    listings worth opening are joined."""
    given = details.where(F.length("detail") > 0).select(F.col("external_id").alias("_id"), "detail")
    rows = listings.join(given, (F.col("external_id") == F.col("_id")) & F.col("worth_opening"), "left")
    opened = F.col("detail").isNotNull()
    card = F.get_json_object("raw", "$.card_text")
    raw = F.to_json(F.struct(card.alias("card_text"), F.substring("detail", 1, DETAIL_CHARS).alias("detail_text")))
    rows = rows.withColumn("description", F.when(opened, F.col("detail")).otherwise(F.col("description")))
    return rows.withColumn("raw", F.when(opened, raw).otherwise(F.col("raw"))).select(listings.columns)

"""Stored listings rebuilt from what was kept of them, ``raw``, and judged again: a parser fix or other criteria need no
new visit to the source.

How a platform's ``raw`` becomes a listing is the source's own way, so what is rebuilt goes through the same code as
what was collected. Nothing is shuffled; only pages are told apart from cards, by platform."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..sources import cards as card_source, pages as page_source
from .criteria import Criteria, judge, judge_parsed
from .store import KEY, as_parsed, reason_codes

#: From rows (platform, raw, and KEEP) to listings with KEEP.
Rebuild = Callable[[DataFrame], DataFrame]
#: Columns that a rebuilt listing carries along: its stored row.
KEEP = ("_stored",)
PARSED = ("title", "description", "price_text", "location_text", "latitude", "longitude", "attributes")


def pages(host: str) -> Rebuild:
    """For platforms whose ``raw`` is a node of a page."""

    def rebuild(rows: DataFrame) -> DataFrame:
        null = lambda kind: F.lit(None).cast(kind)
        nodes = rows.select(null("long").alias("page_id"), null("long").alias("visit"), F.col("raw").alias("node"), null("string").alias("seller"), *KEEP)
        return page_source.to_listings(nodes, None, host, KEEP)

    return rebuild


def cards() -> Rebuild:
    """For platforms whose ``raw`` holds a card's text, and the text of its details if it was opened."""

    def rebuild(rows: DataFrame) -> DataFrame:
        text = lambda name: F.get_json_object("raw", f"$.{name}")
        null = lambda kind: F.lit(None).cast(kind)
        return rows.withColumn("parts", card_source.card_parts(text("card_text"))).select(
            "parts.title", text("detail_text").alias("description"), "parts.price_text", "parts.location_text", null("double").alias("latitude"),
            null("double").alias("longitude"), F.create_map().cast("map<string,string>").alias("attributes"), *KEEP,
        )

    return rebuild


def rebuilt(stored: DataFrame, sources: Mapping[str, Rebuild]) -> DataFrame:
    """The listings behind ``stored`` rows of the platforms in ``sources`` that kept something, each with its stored row."""
    rows = stored.where(F.col("raw").isNotNull()).select("platform", "raw", F.struct(*stored.columns).alias("_stored"))
    out = None
    for platform, rebuild in sources.items():
        mine = rebuild(rows.where(F.col("platform") == platform)).select(*PARSED, *KEEP)
        out = mine if out is None else out.unionByName(mine)
    if out is None:
        raise ValueError("no platform says how its listings are rebuilt")
    return out


def compared(stored: DataFrame, c: Criteria, sources: Mapping[str, Rebuild]) -> DataFrame:
    """Key, ``before``, ``after`` (judged from ``raw`` under ``c``), ``by_columns`` (judged from the stored columns), the
    reason codes that went and came, and ``differs``, whether the two ways disagree: where a parser has changed, or a
    price was kept from an earlier visit."""
    fresh = judge(rebuilt(stored, sources), c).select("_stored.*", F.col("verdict").alias("_after"), reason_codes(F.col("reasons")).alias("_now"))
    rows = fresh.withColumnsRenamed({"verdict": "before", "verdict_reasons": "_before"})
    rows = judge_parsed(as_parsed(rows), c).withColumn("_old", reason_codes(F.col("_before")))
    differs: Column = (F.col("_after") != F.col("verdict")) | (F.col("_now") != reason_codes(F.col("reasons")))
    return rows.select(
        *KEY, "before", F.col("_after").alias("after"), F.col("verdict").alias("by_columns"),
        F.array_except("_old", "_now").alias("gone"), F.array_except("_now", "_old").alias("came"), differs.alias("differs"),
    )

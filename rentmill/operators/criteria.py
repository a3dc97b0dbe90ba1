"""Judging listings: three-valued facts, reason codes and a verdict, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.appliances import appliance_hits, appliances_of
from ..functions.dwelling import parse_dwelling
from ..functions.geo import locate
from ..functions.lexicons import OUTAOUAIS_CITIES
from ..functions.price import is_short_term, parse_price
from ..functions.text import attribute_text, fold

LISTING = """platform string, external_id string, url string, title string, description string, price_text string,
location_text string, latitude double, longitude double, attributes map<string,string>, posted_at timestamp,
seller_name string, raw string"""


@dataclass(frozen=True)
class Criteria:
    max_rent: Decimal = Decimal(2000)
    min_rent: Decimal = Decimal(400)
    require_washer: bool = True
    require_dryer: bool = True
    require_kitchen: bool = True
    exclude_rooms: bool = True
    centre: tuple[float, float] = (45.4765, -75.7013)
    radius_km: float = 40.0
    allow_unknown_province: bool = False

    @property
    def required(self) -> tuple[str, ...]:
        laundry = [n for n, wanted in (("washer", self.require_washer), ("dryer", self.require_dryer)) if wanted]
        return (*laundry, *(("fridge", "stove") if self.require_kitchen else ()))


def check_price(price: Column, c: Criteria) -> tuple[list[Column], list[Column]]:
    short = F.when(is_short_term(price), F.concat(F.lit("short_term_"), price.period, F.lit("ly")))
    range_ = F.when(price.monthly > F.lit(c.max_rent), "over_budget").when(price.monthly < F.lit(c.min_rent), "price_implausible")
    return [short, range_], [F.when(price.isNull(), "price_unknown")]


def check_place(place: Column, c: Criteria) -> tuple[list[Column], list[Column]]:
    unknown = F.when(place.province.isNull(), "province_unknown")
    wrong = F.when(place.province != "QC", F.concat(F.lit("province_not_qc:"), F.lower(place.province)))
    far = F.when(place.distance_km > c.radius_km, "outside_radius")
    near = F.coalesce(place.city.isin(*OUTAOUAIS_CITIES), F.lit(False))
    unsure = F.when(place.distance_km.isNull() & ~near, "proximity_unverified")
    return ([wrong, far], [unknown, unsure]) if c.allow_unknown_province else ([unknown, wrong, far], [unsure])


def check_appliances(found: dict[str, Column], c: Criteria) -> tuple[list[Column], list[Column]]:
    absent = [F.when(found[n].status == "absent", F.concat(F.lit(f"{n}_absent:"), found[n].evidence)) for n in c.required]
    return absent, [F.when(found[n].status == "unknown", f"{n}_unknown") for n in c.required]


def check_dwelling(dwelling: Column, c: Criteria) -> tuple[list[Column], list[Column]]:
    if not c.exclude_rooms:
        return [], []
    room = F.when(dwelling.is_room, F.concat(F.lit("room_rental:"), dwelling.evidence))
    return [room], [F.when(dwelling.is_room.isNull(), "dwelling_type_unknown")]


def conclude(rejections: list[Column], unknowns: list[Column]) -> dict[str, Column]:
    empty = F.array().cast("array<string>")
    return {
        "rejections": F.array_compact(F.array(*rejections)) if rejections else empty,
        "unknowns": F.array_compact(F.array(*unknowns)) if unknowns else empty,
    }


def with_verdict(df: DataFrame) -> DataFrame:
    verdict = F.when(F.size("rejections") > 0, "reject").when(F.size("unknowns") > 0, "maybe").otherwise("match")
    return df.withColumns({"verdict": verdict, "reasons": F.concat("rejections", "unknowns")})


APPLIANCES = ("washer", "dryer", "fridge", "stove", "dishwasher")


def parse(listings: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    """``listings`` with the structs price, place, dwelling and the five appliances. Each text is folded once."""
    rows = listings.withColumn("_attribute_text", attribute_text(F.col("attributes")))
    sources = {"_title": "title", "_description": "description", "_attributes": "_attribute_text", "_price_text": "price_text", "_location": "location_text"}
    rows = rows.withColumns({new: fold(F.col(old)) for new, old in sources.items()})
    corpus = [F.when(F.length(sources[n]) > 0, F.col(n)) for n in ("_title", "_description", "_attributes")]
    rows = rows.withColumn("_corpus", F.array_compact(F.array(*corpus)))
    rows = rows.withColumns({"_clauses": F.array_join("_corpus", " . "), "_line": F.array_join("_corpus", " ")})
    rows = rows.withColumn("_hits", appliance_hits(F.col("_clauses")))
    return rows.withColumns({
        "price": parse_price([F.col("_price_text"), F.col("_title"), F.col("_description")], folded=True),
        "place": locate(F.col("_location"), F.col("latitude"), F.col("longitude"), c.centre, folded=True),
        "dwelling": parse_dwelling(F.col("_line")),
        **appliances_of(F.col("_hits")),
    }).drop(*sources, "_attribute_text", "_corpus", "_clauses", "_line", "_hits")


def judge_parsed(parsed: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    checks = [
        check_price(F.col("price"), c),
        check_place(F.col("place"), c),
        check_appliances({n: F.col(n) for n in APPLIANCES}, c),
        check_dwelling(F.col("dwelling"), c),
    ]
    rows = parsed.withColumns(conclude([x for r, _ in checks for x in r], [x for _, u in checks for x in u]))
    return with_verdict(rows)


def judge(listings: DataFrame, c: Criteria = Criteria()) -> DataFrame:
    """Every listing with its parsed parts, rejections, unknowns, reasons and verdict."""
    return judge_parsed(parse(listings, c), c)

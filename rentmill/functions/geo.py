"""Places from location texts and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lexicons import EARTH_RADIUS_KM, ONTARIO_CITIES, ONTARIO_TOKENS, OUTAOUAIS_CITIES, POSTAL_PROVINCES, QUEBEC_TOKENS
from .text import contains_any, find_any, fold, let

#: A letter-digit postal code of six characters with at most one space or hyphen inside.
POSTAL = "|".join(
    "".join(("[a-z]" if i % 2 == 0 else r"\d") + ("[ -]" if i + 1 == gap else "") for i in range(6)) for gap in (0, 1, 2, 3, 4, 5)
)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def postal_prefix(folded: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(folded, POSTAL, 0), "[ -]", "")
    return F.upper(F.substring(F.nullif(found, F.lit("")), 1, 3))


def province_of_postal(prefix: Column) -> Column:
    province = F.lit("other")
    for letter, name in POSTAL_PROVINCES:
        province = F.when(F.substring(prefix, 1, 1) == letter, name).otherwise(province)
    return F.when(prefix.isNotNull(), province)


def locate(location: Column, latitude: Column, longitude: Column, centre: tuple[float, float], folded: bool = False) -> Column:
    """Struct of province, city, postal_prefix, distance_km and evidence. A postal code decides before tokens of
    Ontario, tokens of Quebec, and cities of either, Ontario's first."""
    def read(text: Column) -> Column:
        framed = F.concat(F.lit(" "), text, F.lit(" "))
        return F.struct(
            postal_prefix(text).alias("prefix"), find_any(text, ONTARIO_CITIES).alias("ontario"), find_any(text, OUTAOUAIS_CITIES).alias("quebec"),
            contains_any(framed, ONTARIO_TOKENS).alias("on"), contains_any(framed, QUEBEC_TOKENS).alias("qc"),
        )

    def place(s: Column) -> Column:
        city, coded = F.coalesce(s.ontario, s.quebec), s.prefix.isNotNull()
        by_city = F.when(s.ontario.isNotNull(), "ON").when(s.quebec.isNotNull(), "QC")
        province = F.when(coded, province_of_postal(s.prefix)).when(s.on, "ON").when(s.qc, "QC").otherwise(by_city)
        evidence = F.when(coded, F.concat(F.lit("postal:"), s.prefix)).when(s.on, "token:on").when(s.qc, "token:qc")
        evidence = evidence.when(city.isNotNull(), F.concat(F.lit("city:"), city)).otherwise("none")
        distance = haversine_km(latitude, longitude, F.lit(centre[0]), F.lit(centre[1]))
        return F.struct(
            province.alias("province"), city.alias("city"), s.prefix.alias("postal_prefix"), distance.alias("distance_km"), evidence.alias("evidence")
        )

    return let(let(location if folded else fold(location), read), place)


def is_quebec(place: Column) -> Column:
    return place.province.eqNullSafe("QC")

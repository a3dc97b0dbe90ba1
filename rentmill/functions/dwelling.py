"""What kind of place an ad is about: rooms, bedrooms, unit type, and whether it is only a room."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .lexicons import ROOM_PHRASES, UNIT_PHRASES, UNIT_TYPES
from .text import contains_any, find_any, let

#: Half-room, piece and bedroom counts, and the largest number that is one.
ROOMS = r"(?<![\d,.])(\d{1,2})\s*[-\s]?\s*1/2"
PIECES = r"(?<![\d,.])(\d{1,2})\s*(?:pieces?|pcs?)\b"
BEDROOMS = r"(?<![\d,.])(\d{1,2})\s*(?:chambres?\s*(?:a\s*coucher)?|cac\b|c\.?a\.?c\b|bedrooms?|bdrms?|bdr\b|br\b)"
MOST_ROOMS = 12
#: Texts without any of these have no such count, and are spared the pattern.
ROOMS_SAY, PIECES_SAY = ("1/2",), ("piece", "pc")
BEDROOMS_SAY = ("chambre", "cac", "c.ac", "ca.c", "c.a.c", "bedroom", "bdr", "br")


def first_count(folded: Column, pattern: str, words: Sequence[str]) -> Column:
    counts = F.transform(F.regexp_extract_all(folded, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    return F.when(contains_any(folded, words), F.get(F.filter(counts, lambda n: (n > 0) & (n <= MOST_ROOMS)), F.lit(0)))


def rooms_to_bedrooms(rooms: Column) -> Column:
    return F.greatest(F.lit(0.0), rooms - 2.5)


def parse_dwelling(folded: Column) -> Column:
    """Struct of is_room, rooms, bedrooms, unit_type and evidence, of a folded text (sources joined by a space)."""
    kind = F.lit(None).cast("string")
    for name, terms in reversed(UNIT_TYPES):
        kind = F.when(contains_any(folded, terms), name).otherwise(kind)
    read = F.struct(
        F.coalesce(first_count(folded, ROOMS, ROOMS_SAY) + F.lit(0.5), first_count(folded, PIECES, PIECES_SAY).cast("double")).alias("rooms"),
        first_count(folded, BEDROOMS, BEDROOMS_SAY).cast("double").alias("bedrooms"), kind.alias("unit_type"),
        find_any(folded, ROOM_PHRASES).alias("room"), find_any(folded, UNIT_PHRASES).alias("unit"),
    )

    def dwelling(s: Column) -> Column:
        is_room = F.when(s.room.isNotNull(), True).when(s.unit.isNotNull() | s.rooms.isNotNull(), False)
        evidence = F.when(s.room.isNotNull(), F.concat(F.lit("room:"), s.room)).when(s.unit.isNotNull(), F.concat(F.lit("unit:"), s.unit))
        evidence = evidence.when(s.rooms.isNotNull(), F.concat(F.lit("rooms:"), s.rooms.cast("string")))
        bedrooms = F.coalesce(s.bedrooms, F.when(s.rooms.isNotNull(), rooms_to_bedrooms(s.rooms)))
        return F.struct(
            is_room.alias("is_room"), s.rooms.alias("rooms"), bedrooms.alias("bedrooms"), s.unit_type.alias("unit_type"), evidence.alias("evidence")
        )

    return let(read, dwelling)

"""Rents from text: currency-marked amounts with the period that follows, normalised to a month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .lexicons import ON_REQUEST, PERIOD_WORDS
from .text import contains_any, fold, let

#: A grouped number, or a plain one, with up to two decimals; the characters after it that name a period.
AMOUNT = r"\d{1,3}(?:[ ,.]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
WINDOW = 24
TAIL = rf"(?=(.{{0,{WINDOW}}}))"
MARKED = rf"(?:(?:\$|cad)\s*({AMOUNT})|({AMOUNT})\s*(?:\$|cad\b|dollars?\b)){TAIL}"
MARKS, RENT_WORDS = ("$", "cad", "dollar"), ("loyer", "rent", "prix", "price")
AFTER_WORD = rf"(?:{'|'.join(RENT_WORDS)})\s*:?\s*({AMOUNT})\b{TAIL}"
MONEY = "decimal(18,2)"


def to_decimal(raw: Column) -> Column:
    """The last of comma and point is the decimal mark, unless just three characters follow: then it groups."""

    def read(text: Column) -> Column:
        tail = F.regexp_extract(text, r"[.,]([^.,]*)$", 1)
        head = F.regexp_replace(F.regexp_replace(text, r"[.,][^.,]*$", ""), "[.,]", "")
        plain = F.when(~text.rlike("[.,]"), text).when(F.length(tail) == 3, F.regexp_replace(text, "[.,]", ""))
        return plain.otherwise(F.concat(head, F.lit("."), tail)).try_cast(MONEY)

    return let(F.replace(raw, F.lit(" "), F.lit("")), read)


def period_of(window: Column) -> Column:
    found = F.lit("unknown")
    for period, words in reversed(PERIOD_WORDS):
        found = F.when(contains_any(window, words), period).otherwise(found)
    return found


def candidates(folded: Column) -> Column:
    """Array of (amount, place, period) in a folded text; ``place`` falls along the text."""

    def read(pattern: str, groups: int) -> Column:
        parts = [F.regexp_extract_all(folded, F.lit(pattern), F.lit(i + 1)) for i in range(groups + 1)]
        rows = F.arrays_zip(*parts)

        def one(row: Column, at: Column) -> Column:
            raw = row["0"] if groups == 1 else F.when(row["0"] != "", row["0"]).otherwise(row["1"])
            return F.struct(to_decimal(raw).alias("amount"), (-at).alias("place"), period_of(row[str(groups)]).alias("period"))

        return F.filter(F.transform(rows, one), lambda c: c.amount.isNotNull())

    # Most texts have none of the words that a pattern needs, and are spared it.
    marked, after = (F.when(contains_any(folded, words), read(p, n)) for words, p, n in ((MARKS, MARKED, 2), (RENT_WORDS, AFTER_WORD, 1)))
    return let(marked, lambda found: F.when(F.size(found) > 0, found).otherwise(after))


def monthly(amount: Column, period: Column) -> Column:
    wide = amount.cast("decimal(24,2)")
    rent = F.when(period == "week", F.bround(wide * 52 / 12, 2)).when(period == "day", F.bround(wide * 365 / 12, 2))
    return rent.otherwise(wide).try_cast(MONEY)


def parse_price(sources: Sequence[Column], folded: bool = False) -> Column:
    """Struct (amount, period, monthly) or null, from texts in order of trust. The largest positive amount of the
    first text that has one counts, unless a text before it, or itself, says the price is on request."""
    read = lambda text: F.struct(contains_any(text, ON_REQUEST).alias("asked"), F.array_max(candidates(text)).alias("best"))
    found = F.transform(F.array(*(s if folded else fold(s) for s in sources)), read)
    deciding = F.get(F.filter(found, lambda f: f.asked | F.coalesce(f.best.amount > 0, F.lit(False))), F.lit(0))

    def price(f: Column) -> Column:
        rent = monthly(f.best.amount, f.best.period).alias("monthly")
        return F.when(~f.asked, F.struct(f.best.amount.alias("amount"), f.best.period.alias("period"), rent))

    return let(deciding, price)


def is_short_term(price: Column) -> Column:
    return F.coalesce(price.period.isin("week", "day"), F.lit(False))

"""Text folding and lexicon look-ups as columns."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column, functions as F

from .lexicons import APOSTROPHES, DASHES, FRACTION_SLASH

#: All characters that fold to anything but themselves are in here: the two lower planes without ideographs, Hangul
#: syllables, surrogates and private use, then compatibility ideographs and variation selectors.
BLOCKS = ((0x80, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE01F0))
#: Hangul syllables are put together from so many consonants, vowels and last consonants, the first of which is none.
SYLLABLE, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
N_LEADS, N_VOWELS, N_TAILS = 19, 21, 28
#: Lower-cased by its place in the word, so it is left to ``lower``.
FINAL_SIGMA = "Σ"
#: White space, but for single plain spaces.
SPACES = r"[\s\x1c-\x1f\x{85}\x{1680}\x{2028}\x{2029}]{2,}|[\t-\r\x1c-\x1f\x{85}\x{1680}\x{2028}\x{2029}]"
#: Characters that become several and are common in ads.
FREQUENT = "½¼¾…"
#: What texts in French and English are made of. None of these characters is rare.
USUAL = ((0x0, 0x132), (0x150, 0x154), (0x2000, 0x2025), (0x2026, 0x2033), (0x20AC, 0x20AD))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_character(c: str) -> str:
    """What one character folds to: compatibility forms resolved, marks dropped, lower case."""
    text = unicodedata.normalize("NFKC", c)
    text = text.translate({**dict.fromkeys(map(ord, APOSTROPHES), "'"), **dict.fromkeys(map(ord, DASHES), "-"), ord(FRACTION_SLASH): "/"})
    return "".join(x for x in unicodedata.normalize("NFD", text) if unicodedata.category(x) != "Mn").lower()


@cache
def tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that become one character or none, as arguments of ``translate``; those that become several."""
    single, deleted, several = [], [], []
    for c in [chr(i) for a, b in BLOCKS for i in range(a, b)] + list("`"):
        to = fold_character(c)
        if to == c or c == FINAL_SIGMA:
            continue
        (several if len(to) > 1 else single if to else deleted).append((c, to))
    return "".join(c for c, _ in single + deleted), "".join(t for _, t in single), tuple(several)


def ranges(points: list[int], gap: int = 64) -> str:
    """A short character class with all ``points``, and with others that lie between near ones beyond Latin script."""
    spans: list[list[int]] = []
    for p in points:
        if spans and p - spans[-1][1] <= (gap if p > 0x250 else 1):
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def fold(text: Column) -> Column:
    """Lower-case text without accents, with plain punctuation and single spaces; null becomes empty.

    A pass of ``translate`` does most, where a text has anything but plain ASCII, and a second one with all characters
    where it then has one that isn't usual: folding what is folded changes nothing. The rare characters that become several are replaced only in texts that have one."""
    source, target, several = tables()
    usual = lambda t: F.translate(spelt_out(t, several), *usual_tables())
    rest = lambda t: F.when(~is_ascii(t) & t.rlike(unusual()), unaccented(t, source, target, several)).otherwise(t)
    spaced = lambda t: F.when(may_have_spaces(t), F.regexp_replace(t, SPACES, " ")).otherwise(t)
    text = F.coalesce(text, F.lit(""))
    text = F.when(~is_ascii(text) | F.contains(text, F.lit("`")), let(usual(text), rest)).otherwise(text)
    return F.trim(let(F.lower(text), spaced))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def may_have_spaces(text: Column) -> Column:
    """Whether the text can have any of ``SPACES``. Scanning for a few bytes is much cheaper than matching a class."""
    found = ~is_ascii(text)
    for c in ("  ", *"\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
        found = found | F.contains(text, F.lit(c))
    return found


def is_usual(c: str) -> bool:
    return any(a <= ord(c) < b for a, b in USUAL)


@cache
def unusual() -> str:
    """A pattern of texts with a character that isn't usual."""
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}" for a, b in USUAL) + "]"


@cache
def usual_tables() -> tuple[str, str]:
    """What ``tables`` has of usual characters that become one character or none."""
    source, target, _ = tables()
    single = [(a, b) for a, b in zip(source, target, strict=False) if is_usual(a)]
    deleted = [a for a in source[len(target):] if is_usual(a)]
    return "".join([a for a, _ in single] + deleted), "".join(b for _, b in single)


@cache
def syllables() -> tuple[str, tuple[str, str, str]]:
    """All Hangul syllables, those without a last consonant at the end; and the letters at each of their three places."""
    points = [(x, v, t) for t in range(N_TAILS - 1, -1, -1) for x in range(N_LEADS) for v in range(N_VOWELS)]
    whole = "".join(chr(SYLLABLE + (x * N_VOWELS + v) * N_TAILS + t) for x, v, t in points)
    return whole, ("".join(chr(LEADS + x) for x, _, _ in points), "".join(chr(VOWELS + v) for _, v, _ in points), "".join(chr(TAILS + t) for _, _, t in points if t))


FIRST_SYLLABLE, LAST_SYLLABLE = chr(SYLLABLE), chr(SYLLABLE + N_LEADS * N_VOWELS * N_TAILS - 1)


def without_syllables(text: Column) -> Column:
    """Hangul syllables as the letters that they are made of."""
    whole, letters = syllables()
    apart = lambda c: F.concat(*(F.translate(c, whole, to) for to in letters))
    each = lambda c: F.when((c >= FIRST_SYLLABLE) & (c <= LAST_SYLLABLE), apart(c)).otherwise(c)
    return F.when(text.rlike(f"[{FIRST_SYLLABLE}-{LAST_SYLLABLE}]"), F.array_join(F.transform(F.split(text, ""), each), "")).otherwise(text)


@cache
def rare_characters() -> tuple[str, str]:
    """JSON of the pairs of rare characters that become several, and a pattern of texts that may have one, or a syllable."""
    rare = [{"a": a, "b": b} for a, b in tables()[2] if a not in FREQUENT]
    some = ranges(sorted([ord(p["a"]) for p in rare] + [ord(FIRST_SYLLABLE), ord(LAST_SYLLABLE)]))
    return json.dumps(rare), f"{some[:-1]}{FIRST_SYLLABLE}-{LAST_SYLLABLE}]"


def spelt_out(text: Column, several: tuple[tuple[str, str], ...]) -> Column:
    """``text`` without the frequent characters that become several; looking for all is cheaper than replacing none."""
    spelt = text
    for a, b in several:
        if a in FREQUENT:
            spelt = F.replace(spelt, F.lit(a), F.lit(b))
    return F.when(contains_any(text, list(FREQUENT)), spelt).otherwise(text)


def unaccented(text: Column, source: str, target: str, several: tuple[tuple[str, str], ...]) -> Column:
    rare, some = rare_characters()
    # One constant, where an array of literals would make a plan of thousands of nodes.
    pairs = F.from_json(F.lit(rare), "array<struct<a:string,b:string>>")
    spread = lambda t: let(F.aggregate(pairs, t, lambda t, p: F.replace(t, p.a, p.b)), without_syllables)
    return F.translate(let(text, lambda t: F.when(t.rlike(some), spread(t)).otherwise(t)), source, target)


def literals(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def found(folded: Column, needles: Column) -> Column:
    """Those of an array of ``needles`` that the text contains."""
    return F.filter(needles, lambda n: F.contains(folded, n))


def first_found(folded: Column, needles: Column) -> Column:
    return F.get(found(folded, needles), F.lit(0))


def contains_any(folded: Column, needles: Sequence[str]) -> Column:
    return F.exists(literals(needles), lambda n: F.contains(folded, n))


def find_any(folded: Column, needles: Sequence[str]) -> Column:
    """The first of ``needles``, in their order, that the text contains; else null."""
    return first_found(folded, literals(needles))


def joined(sources: Sequence[Column], separator: str) -> Column:
    """The folded texts that weren't empty before folding, joined."""
    given = F.array(*(F.when(F.length(s) > 0, fold(s)) for s in sources))
    return F.array_join(F.array_compact(given), separator)


def attribute_text(attributes: Column) -> Column:
    """``key value`` pairs by key, joined by spaces; a null value reads None."""
    entries = F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.struct(e.key.alias("key"), F.coalesce(e.value, F.lit("None")).alias("value"))))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit(" "), e.value)), " "), F.lit(""))

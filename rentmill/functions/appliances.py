"""Appliances in ads: present, absent or unknown, with the phrase that decided."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .lexicons import APPLIANCE_TERMS, CLAUSE_ENDS, HOOKUP_MARKERS, KITCHEN_BUNDLE, NEGATED_AFTER, NEGATED_BEFORE, SHARED_MARKERS
from .text import contains_any, first_found, found, let, literals

#: Characters before and after a hit that can qualify it, and those that can negate it.
BEFORE, AFTER, NEAR = 32, 40, 14
#: A character that folded texts don't have.
MARK = "\x1c"
CLAUSE_END = "."


def hits_pattern(terms: Sequence[str]) -> str:
    return r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, terms)) + r")s?(?![a-z0-9])"


def own_clause(context: Column, which: int) -> Column:
    """The last (-1) or first (1) clause of ``context``."""
    return F.substring_index(context, CLAUSE_END, which)


def plain_ends(folded: Column) -> Column:
    """``folded`` with one character for all ends of clauses. No term or marker has any of them."""
    others = [c for c in CLAUSE_ENDS if c != CLAUSE_END]
    return F.when(contains_any(folded, others), F.translate(folded, "".join(others), CLAUSE_END * len(others))).otherwise(folded)


def markers_in(folded: Column) -> Column:
    """Of each list of markers those that the text has anywhere, in order. Most texts have few; hits look for these only."""
    lists = {"hookup": HOOKUP_MARKERS, "shared": SHARED_MARKERS, "later": NEGATED_AFTER, "earlier": NEGATED_BEFORE}
    return F.struct(*(found(folded, literals(words)).alias(name) for name, words in lists.items()))


def classify(before: Column, term: Column, after: Column, markers: Column) -> Column:
    """Struct (present, evidence) of one hit, by which ``markers`` its own clause has around it."""
    def read(s: Column) -> Column:
        around = F.concat(s.before, F.lit("\n"), s.after)
        near = F.when(F.length(s.before) > NEAR, F.right(s.before, F.lit(NEAR))).otherwise(s.before)
        return F.coalesce(
            F.concat(F.lit("hookup:"), first_found(around, markers.hookup)),
            F.concat(F.lit("shared:"), first_found(around, markers.shared)),
            F.concat(F.lit("negated:"), first_found(s.after, markers.later)),
            F.concat(F.lit("negated:"), F.trim(first_found(near, markers.earlier))),
        )

    clause = F.struct(own_clause(before, -1).alias("before"), own_clause(after, 1).alias("after"))
    verdict = lambda absent: F.struct(absent.isNull().alias("present"), F.coalesce(absent, term).alias("evidence"))
    return let(let(clause, read), verdict)


def plurals(terms: Sequence[str]) -> list[str]:
    return [t + s for t in terms for s in ("", "s")]


def meet(a: str, b: str) -> bool:
    """Whether a hit of ``b`` can begin inside a hit of ``a``, or where it begins. Hits begin and end at word limits."""
    starts = (i for i in range(len(a)) if i == 0 or not a[i - 1].isalnum())
    return any(b.startswith(a[i:]) or a[i:].startswith(b) for i in starts)


def passes(lexicons: Sequence[tuple[str, Sequence[str]]]) -> list[list[tuple[str, Sequence[str]]]]:
    """``lexicons`` dealt to as few passes as their order allows, so that in one pass no two lexicons' hits overlap."""
    out: list[list[tuple[str, Sequence[str]]]] = []
    clash = lambda xs, ys: any(meet(x, y) or meet(y, x) for x in plurals(xs) for y in plurals(ys))
    for name, terms in lexicons:
        free = next((p for p in out if not any(clash(terms, others) for _, others in p)), None)
        if free is None:
            out.append([(name, terms)])
        else:
            free.append((name, terms))
    return out


def hits(folded: Column, lexicons: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Array of (name, present, evidence) of all hits of ``lexicons``, whose hits don't overlap. One pass of their pattern
    marks them; between marks, every second piece is a term, and the context of each is cut out of the pieces around
    it."""
    pattern = hits_pattern([t for _, terms in lexicons for t in terms])
    pieces = F.split(F.regexp_replace(folded, pattern, f"{MARK}$0{MARK}"), MARK)
    name_of = F.create_map(*(F.lit(x) for name, terms in lexicons for t in dict.fromkeys(plurals(terms)) for x in (t, name)))

    def one(parts: Column, i: Column, markers: Column) -> Column:
        before = F.array_join(F.slice(parts, F.lit(1), i), "")
        after = F.array_join(F.slice(parts, i + 2, F.size(parts)), "")
        near = F.when(F.length(before) > BEFORE, F.right(before, F.lit(BEFORE))).otherwise(before)
        name = name_of[F.get(parts, i)].alias("name")
        return let(classify(near, F.get(parts, i), F.substring(after, 1, AFTER), markers), lambda h: F.struct(name, h.present.alias("present"), h.evidence.alias("evidence")))

    each = lambda parts, m: F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: one(parts, i, m))
    some = lambda parts: let(markers_in(folded), lambda m: each(parts, m))
    return let(pieces, lambda parts: F.when(F.size(parts) > 1, some(parts)))


def decide(found: Column, name: str) -> Column:
    """Struct (status, evidence): the first present hit of ``name``, else its first absent one, else unknown."""
    mine = F.filter(found, lambda h: h["name"] == name)
    first = let(mine, lambda hs: F.coalesce(F.get(F.filter(hs, lambda h: h.present), F.lit(0)), F.get(hs, F.lit(0))))
    status = lambda f: F.when(f.isNull(), "unknown").when(f.present, "present").otherwise("absent")
    return let(first, lambda f: F.struct(status(f).alias("status"), f.evidence.alias("evidence")))


def with_bundle(found: Column, bundle: Column) -> Column:
    """A present kitchen bundle fills in what is unknown."""
    filled = F.struct(F.lit("present").alias("status"), F.concat(F.lit("bundle:"), bundle.evidence).alias("evidence"))
    return F.when((found.status == "unknown") & (bundle.status == "present"), filled).otherwise(found)


def appliance_hits(folded: Column) -> Column:
    """The hits of all appliances, and of the kitchen bundle, in a folded text."""
    lexicons = passes([*APPLIANCE_TERMS, ("bundle", KITCHEN_BUNDLE)])

    def read(text: Column) -> Column:
        found = [hits(text, p) for p in lexicons]
        return found[0] if len(found) == 1 else F.concat(*(F.coalesce(f, F.array()) for f in found))

    return let(plain_ends(folded), read)


def appliances_of(found: Column) -> dict[str, Column]:
    """The five appliances of ``appliance_hits``; a column that has these, so that they are found once."""
    out = {name: decide(found, name) for name, _ in APPLIANCE_TERMS}
    bundle = decide(found, "bundle")
    return out | {n: let(F.struct(out[n].alias("own"), bundle.alias("all")), lambda s: with_bundle(s.own, s.all)) for n in ("fridge", "stove")}


def detect_appliances(folded: Column) -> dict[str, Column]:
    """The five appliances in a folded text, whose sources were joined by a clause end (" . ")."""
    return appliances_of(appliance_hits(folded))


def included(found: Column) -> Column:
    return found.status == "present"


def flags(found: dict[str, Column]) -> dict[str, Column]:
    """What is included, one by one and in pairs: laundry is washer and dryer, a kitchen is fridge and stove."""
    each = {f"{name}_included": included(c) for name, c in found.items()}
    return each | {
        "has_laundry": included(found["washer"]) & included(found["dryer"]),
        "has_kitchen": included(found["fridge"]) & included(found["stove"]),
    }

"""Mixing sources to target weights with a time-varying curriculum, in DataFrame functions only.

Sources ordered by code point (null last) weigh 1, 2, 3, repeating, and share all words by weight; a target stops at
``max_repeats`` times its source's size, and the excess is shared again by weight until none is above.

A source's documents, in the order of the MD5 of their doc_id, form a stream of words that is read up to
``max_repeats`` times, until the target is reached. Documents are taken whole: the one that the target falls into is
taken if that is nearer to the target than leaving it, so a source is off by half a document at most. Each weight class has a schedule,
its relative weight over training time 0..1, linear between equally spaced knots. The schedule's integral is the
source's cumulative demand of words; inverting it at the middle of each copy gives the copy's training position.

Only doc_id, source, size and MD5 are shuffled. Running sums go first over 4,096 hash ranges of a source, then inside
one range, so no task sorts a whole source. The source table (one row a source) goes through one task.

Null texts have no words. Documents without words are never taken. Repeated rows are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import content_hash, materialise, row_keys

WORD = r"[^\x20\x09-\x0D]+"
#: Weight of a source -> its schedule at equally spaced times from 0 to 1.
SCHEDULES = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.5, 1.0, 1.5)}


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        *(key.alias(f"_rm_{name}") for name, key in row_keys("source").items()),
        size(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order"),
    )


def targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source, source_size, weight, target: the weighted shares of all words, filled up to ``max_repeats`` sizes."""
    whole = lambda c: c.cast("decimal(38,0)")
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("weight", (F.row_number().over(by_source) - 1) % 3 + 1).withColumn("most", F.col("source_size") * max_repeats)
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumns({
        "total": F.sum("source_size").over(all_rows),
        "filled": F.coalesce(F.sum("most").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    below = whole(F.col("most")) * whole(F.col("open")) < whole(F.col("weight")) * whole(F.col("total") - F.col("filled"))
    t = t.withColumn("below", below)
    t = t.withColumn("full", F.min("below").over(fill.rowsBetween(W.unboundedPreceding, W.currentRow)))
    t = t.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(all_rows), F.lit(0)),
        "sharing": F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_rows),
    })
    share = whole(F.col("weight")) * whole(F.col("rest"))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(share.cast("double") / F.col("sharing").cast("double"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def invert(share: Column, knots: tuple[float, ...]) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its whole."""
    step = 1.0 / (len(knots) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, time = sum(areas), 0.0, F.lit(1.0)
    pieces = []
    for i, area in enumerate(areas):
        a, b = knots[i], knots[i + 1]
        within = share * whole - before
        if a == b:
            t = within / a
        else:
            slope = (b - a) / step
            t = (F.sqrt(F.greatest(F.lit(0.0), a * a + within * (2 * slope))) - a) / slope
        pieces.append((before + area, t + i * step))
        before += area
    for end, t in reversed(pieces):
        time = F.when(share * whole <= end, t).otherwise(time)
    return time


def planned(docs: DataFrame, max_repeats: int = 3, schedules: dict[int, tuple[float, ...]] | None = None) -> DataFrame:
    """``plan`` with 128 bits of doc_id, text and source of each row."""
    rows = materialise(sized(docs), "sizes").withColumn("bucket", F.substring("order", 1, 3))
    goals = targets(rows, max_repeats)
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    buckets = buckets.select("source", "bucket", before(W.partitionBy("source").orderBy("bucket")).alias("bucket_start"))
    buckets = buckets.join(goals, buckets.source.eqNullSafe(goals.source)).drop(goals.source)
    inner = W.partitionBy("source", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "size", "_rm_key", "_rm_check")
    rows = rows.withColumn("inner_start", before(inner))
    same = rows.source.eqNullSafe(buckets.source) & (rows.bucket == buckets.bucket)
    rows = rows.join(buckets, same).drop(buckets.source, buckets.bucket)
    goal = F.floor("target")
    copies = []
    for n in range(max_repeats):
        start = F.col("bucket_start") + F.col("inner_start") + F.col("source_size") * n
        share = (start + F.col("size") / 2) / goal
        time = F.lit(None).cast("double")
        for weight, knots in (schedules or SCHEDULES).items():
            time = F.when(F.col("weight") == weight, invert(share, knots)).otherwise(time)
        taken = (F.col("size") > 0) & (2 * start + F.col("size") <= 2 * goal)
        copies.append(F.when(taken, F.struct(time.alias("position"), F.col("size").alias("words"))))
    rows = rows.withColumn("copies", F.array_compact(F.array(*copies)))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c.words)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "_rm_key", "_rm_check")


def plan(docs: DataFrame, max_repeats: int = 3, schedules: dict[int, tuple[float, ...]] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and ``copies``, an array of
    (position, words) of the copies that the mix takes, first to last."""
    return planned(docs, max_repeats, schedules).drop("_rm_key", "_rm_check")


def curriculum(planned: DataFrame) -> DataFrame:
    """``planned``, range-sorted by the position of each document's first copy; documents never taken come last."""
    first = F.get("copies", F.lit(0)).position
    return planned.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The training stream: a row of ``docs`` for each copy that the mix takes, range-sorted by position.

    Documents and their plans meet by one shuffle on 128 bits of doc_id, text and source: repeated rows are numbered on
    either side (documents by a hash of all columns), and the n-th document takes the plan next to it. Documents and
    their columns stay as they are."""
    key, check = (F.col(f"_rm_{name}") for name in ("key", "check"))
    taken = planned(docs).select("_rm_key", "_rm_check", F.lit(0).alias("_rm_side"), F.col("copies").alias("_rm_copies"))
    first = F.get("_rm_copies", F.lit(0)).position
    taken = taken.withColumn("_rm_tie", F.coalesce((first * (1 << 52)).cast("long"), F.lit((1 << 63) - 1)))
    mine = docs.withColumns({f"_rm_{name}": k for name, k in row_keys("source").items()})
    mine = mine.withColumns({"_rm_side": F.lit(1), "_rm_tie": content_hash(docs)})
    both = mine.unionByName(taken, allowMissingColumns=True)
    both = both.withColumn("_rm_nth", F.row_number().over(W.partitionBy(key, check, "_rm_side").orderBy("_rm_tie")))
    beside = F.lag("_rm_copies").over(W.partitionBy(key, check, "_rm_nth").orderBy("_rm_side"))
    rows = both.withColumn("_rm_copies", beside).where("_rm_side = 1").withColumn("_rm_copy", F.explode("_rm_copies"))
    return rows.orderBy("_rm_copy.position", "doc_id").select(docs.columns)

"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

1. Each text becomes the SHA-256 of itself without white space; digests, not texts, are what moves.
2. A frequent-items sketch (Misra-Gries with the counters of Apache DataSketches, Spark's ``approx_top_k``) over
   all digests names at most ``heavy`` candidates. Any digest with more than a few ``1 / tracked`` of the rows is
   among the tracked ones, and all of these that occur twice are candidates.
3. The candidates' exact counts and winners come from a map-side combined aggregate; this table has at most
   ``heavy`` rows of about 200 bytes (2 MB), so it is broadcast, and rows of frequent digests are resolved where
   they are.
4. The other digests, each of which has at most a few ``1 / tracked`` of the rows, are grouped and joined by an
   ordinary shuffle.

Null texts count as empty. Of equal texts the row with the most code points stays, then the smallest doc_id (null
last), then the smallest hash of doc_id and text. Repeated rows are told apart by a row number kept with the digests,
so that one of them stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import content_hash, materialise, row_keys

#: Spark's sketch holds this many counters; the bound on the broadcast table is HEAVY rows.
TRACKED, HEAVY = 10_000, 10_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _winner() -> list[Column]:
    best = F.struct(F.col("points"), F.col("doc_id").isNotNull(), -F.coalesce("doc_id", F.lit(0)), F.col("key"), F.col("check"), -F.col("row_no"))
    return [
        F.count("*").alias("group_size"),
        F.max_by(F.struct(F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row")), best).alias("best"),
    ]


def decide(docs: DataFrame, text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, points."""
    return decided(docs.select("doc_id", F.col(text).alias("text")), heavy).drop("key", "check")


def decided(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``decide`` with the key and check of each row of ``docs`` (doc_id, text)."""
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            digest(F.col("text")).alias("text_sha256"),
            F.length(F.coalesce("text", F.lit(""))).alias("points"),
            F.monotonically_increasing_id().alias("row_no"),
            *(key.alias(name) for name, key in row_keys().items()),
        ),
        "digests",
    )
    candidates = (
        rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {TRACKED})").alias("top"))
        .select(F.explode("top").alias("top"))
        .where("top.count > 1")
        .select(F.col("top.item").alias("text_sha256"))
    )
    winners = materialise(
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*_winner()), "winners"
    )
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    others = rest.join(rest.groupBy("text_sha256").agg(*_winner()), "text_sha256")
    kept = (F.col("row_no") == F.col("best.keep_row")).alias("kept")
    columns = ["doc_id", "best.keep_id", "group_size", kept, "text_sha256", "points", "key", "check"]
    return frequent.select(columns).unionByName(others.select(columns))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    The winners meet their texts again by 128 bits of doc_id and text, which are also what repeated rows are dealt by,
    so texts are shuffled once; of repeated rows the first by a hash of all columns stays."""
    stay = decided(docs.select("doc_id", "text")).where("kept").select(F.col("key").alias("_rm_key"), F.col("check").alias("_rm_check"))
    mine = docs.withColumns({f"_rm_{name}": key for name, key in row_keys().items()})
    nth = F.row_number().over(W.partitionBy("_rm_key", "_rm_check").orderBy(content_hash(docs)))
    return mine.join(stay, ["_rm_key", "_rm_check"]).withColumn("_rm_nth", nth).where("_rm_nth = 1").select(docs.columns)

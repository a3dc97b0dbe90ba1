"""Hard-negative mining by exact top-k searches over a vector-approximation file.

An anchor's positives are its best rows of the same label; of each positive the hard negatives are the best rows of
other labels whose score lies in a window, ``least`` to ``most`` percent of the positive's. Scores are inner products of
integer vectors, ties go to smaller ids.

**File.** Each dimension is cut into ``CELLS`` cells at quantiles of all rows' components (the outer cells end at the
least and the largest); a row's approximation is its cell in each dimension, a byte each. It is written beside the vector.

**Bounds.** For an anchor and a cell the smallest and the largest product are known, so an anchor has a table of both for
each dimension; adding up what a row's bytes find there gives a lower and an upper bound of its score.

**Search.** A task goes through its rows in slices and keeps the best of each window. Exactly scored are only rows whose
bounds let them into a window: the upper bound reaches its floor and what the window has kept so far, the lower bound
doesn't exceed its ceiling. A window that isn't full yet asks for as much as its best surely fitting rows of the slice
have at least; slices begin small and double, so that windows fill up at a small cost. What the tasks keep, at most the limit for each window, is ranked once more by a window function.

**Scale.** Rows stay where they are. Anchors are sent to the tasks in blocks of at most ``block``, one block after
another, so what is broadcast and what comes to the driver (a block's anchors, and their positives) has a fixed bound.
Work is anchors x rows, as the search is exact.

**Defined cases.** Rows with a null label, a null vector, or a null or non-finite component take no part. Components a
vector lacks count as 0. A row is never a positive or negative of an anchor with its own id. Of rows that share an
anchor's id one, the smallest by label and vector, is the anchor; as candidates repeated rows all count. Rows without an
id are candidates, last on ties. No anchors, or no rows: no result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import materialise, new_path
from .vectors import best, matrix, received_id, scaled, sent_ids, usable

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
CELLS = 64
ANY = 1 << 62
#: Rows and anchors whose bounds are found at a time: 2 x 4 or 8 bytes for each pair. Rows of a task's first slice.
SLICE, GROUP, FIRST = 4096, 64, 64


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    #: Bounds of a negative's score, in percent of the positive's.
    least: int = 30
    most: int = 90
    #: Anchors sent to the tasks at a time.
    block: int = 4096


@dataclass(frozen=True)
class Cells:
    """The smallest and the largest component of each cell, by dimension; inner ends are the cells' marks."""

    low: np.ndarray
    high: np.ndarray

    @property
    def width(self) -> int:
        return len(self.low)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The approximations of ``rows``: the number of the cell in each dimension."""
        cells = np.empty(rows.shape, np.uint8)
        for d in range(self.width):
            cells[:, d] = np.searchsorted(self.high[d, :-1], rows[:, d])
        return cells

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By dimension, cell and anchor: the least and the largest that a row of this cell can score there."""
        ends = np.stack([self.low[:, :, None] * anchors.T[:, None, :], self.high[:, :, None] * anchors.T[:, None, :]])
        out = []
        for t in (ends.min(0), ends.max(0)):
            small = np.abs(t).max(axis=(1, 2), initial=0).sum() < 1 << 31
            out.append(t.astype(np.int32) if small else t)
        return out[0], out[1]


def look_up(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = table[0].take(codes[:, 0], axis=0)
    for i in range(1, len(table)):
        total += table[i].take(codes[:, i], axis=0)
    return total


def cells_of(rows: DataFrame) -> Cells:
    """Cells by quantiles of the components of all ``rows``. A handful of numbers a dimension reach the driver."""
    quantiles = [(i + 1) / CELLS for i in range(CELLS - 1)]
    each = rows.select(F.posexplode("cells").alias("dim", "x")).groupBy("dim")
    found = {r.dim: r for r in each.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", quantiles, 1000).alias("marks")).collect()}
    width = max([*found, 0]) + 1
    low, high = np.zeros((width, CELLS), np.int64), np.zeros((width, CELLS), np.int64)
    for d, r in found.items():  # 0 lies in a cell everywhere: it stands for what a vector lacks
        low[d] = [min(r.least, 0), *(m + 1 for m in r.marks)]
        high[d] = [*r.marks, max(r.most, 0)]
    return Cells(low, high)


def approximated(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` (id, none, label, asks, cells) with their approximations, ``code``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = cells.codes(matrix(batch["cells"], cells.width))
            yield batch.assign(code=[c.tobytes() for c in codes])

    return rows.mapInPandas(run, "id long, none boolean, label long, asks boolean, cells array<int>, code binary")


@dataclass(frozen=True)
class Block:
    """Anchors, and their windows by slot: ``floor`` and ``ceiling`` of scores (none where the floor is above)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    floor: np.ndarray
    ceiling: np.ndarray

    def part(self, start: int) -> Block:
        to = slice(start, start + GROUP)
        return Block(self.ids[to], self.labels[to], self.vectors[to], self.floor[:, to], self.ceiling[:, to])


class Kept:
    """The best of each window so far; a window's key is its anchor's place times the number of slots, plus the slot."""

    def __init__(self, slots: int, anchors: int, limit: int) -> None:
        self.slots, self.limit = slots, limit
        self.columns = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        #: What a full window asks for at least.
        self.asked = np.full((slots, anchors), -ANY)

    def add(self, keys: np.ndarray, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        together = [np.concatenate(pair) for pair in zip(self.columns, (keys, scores, none, ids), strict=True)]
        kept = best(*together, self.limit)
        self.columns = tuple(c[kept] for c in together)
        keys, scores = self.columns[:2]
        last = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(0, np.int64)
        full = last[np.diff(np.r_[-1, last]) == self.limit]
        self.asked[keys[full] % self.slots, keys[full] // self.slots] = scores[full]


def search(rows: pd.DataFrame, codes: np.ndarray, vectors: np.ndarray, block: Block, cells: Cells, kept: Kept, same: bool) -> None:
    """Offer a slice of rows to the windows of a block's anchors."""
    ids, none, labels = (rows[c].to_numpy() for c in ("id", "none", "label"))
    lower, upper = (look_up(codes, t) for t in cells.tables(block.vectors))
    allowed = (labels[:, None] == block.labels) == same
    allowed &= (ids[:, None] != block.ids) | none[:, None]
    some = np.zeros_like(allowed)
    for slot, (floor, ceiling) in enumerate(zip(block.floor, block.ceiling, strict=True)):
        asked = np.where(floor > ceiling, ANY, np.maximum(kept.asked[slot], floor))
        unsure = np.flatnonzero((floor <= ceiling) & (kept.asked[slot] == -ANY))
        if len(rows) >= kept.limit and len(unsure):
            low, up = lower[:, unsure], upper[:, unsure]
            surely = np.where(allowed[:, unsure] & (low >= floor[unsure]) & (up <= ceiling[unsure]), low, np.int64(-ANY))
            asked[unsure] = np.maximum(asked[unsure], np.partition(surely, -kept.limit, axis=0)[-kept.limit])
        some |= (upper >= asked) & (lower <= ceiling)
    row, anchor = np.nonzero(some & allowed)
    if not len(row):
        return
    scores = np.einsum("ij,ij->i", vectors[row], block.vectors[anchor])
    for slot in range(kept.slots):
        fits = (scores >= np.maximum(kept.asked[slot], block.floor[slot])[anchor]) & (scores <= block.ceiling[slot][anchor])
        r, a = row[fits], anchor[fits]
        if len(r):
            kept.add(a * kept.slots + slot, scores[fits], none[r], ids[r])


def found_in(table: DataFrame, block: Block, cells: Cells, limit: int, same: bool) -> DataFrame:
    """anchor, slot, id, none, score, rank: the first ``limit`` of each window of ``block``, among rows of the same
    label or of others."""
    sent = table.sparkSession.sparkContext.broadcast(block)
    slots = len(block.floor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = range(0, len(sent.value.ids), GROUP)
        parts = [sent.value.part(s) for s in starts]
        kept = [Kept(slots, len(p.ids), limit) for p in parts]
        size = FIRST
        for batch in batches:
            at = 0
            while at < len(batch):
                rows = batch.iloc[at : at + size]
                at, size = at + size, min(2 * size, SLICE)
                codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), cells.width)
                vectors = matrix(rows["cells"], cells.width)
                for part, mine in zip(parts, kept, strict=True):
                    search(rows, codes, vectors, part, cells, mine, same)
        for start, mine in zip(starts, kept, strict=True):
            keys, scores, none, ids = mine.columns
            yield pd.DataFrame({"anchor": start + keys // slots, "slot": keys % slots, "id": ids, "none": none, "score": scores})

    each = table.select("id", "none", "label", "code", "cells").mapInPandas(run, "anchor long, slot int, id long, none boolean, score long")
    order = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "none", "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def blocks_of(table: DataFrame, size: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of the anchors of ``table``, at most ``size`` at a time."""
    asking = table.where("asks").groupBy("id").agg(F.min(F.struct("label", "cells")).alias("row"))
    asking = materialise(asking.select("id", "row.*"), "anchors")
    count = asking.count()
    number = -(-2 * count // size)  # half full on average, as a hash deals them
    for b in range(number):
        rows = asking.where(F.pmod(F.xxhash64("id"), F.lit(number)) == b).orderBy("id").limit(size + 1).collect()
        if len(rows) > size:
            raise RuntimeError(f"a block has more than {size} anchors")
        if rows:
            yield np.array([r.id for r in rows]), np.array([r.label for r in rows]), matrix([r.cells for r in rows], width)


def windows(scores: list[list[int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Floors and ceilings by slot and anchor of the positives' ``scores``."""
    floor = np.ones((s.positives, len(scores)), np.int64)
    ceiling = np.zeros((s.positives, len(scores)), np.int64)
    for a, mine in enumerate(scores):
        for slot, score in enumerate(mine):
            floor[slot, a], ceiling[slot, a] = -(-s.least * score // 100), s.most * score // 100
    return floor, ceiling


def hard_negatives(vectors: DataFrame, is_anchor: Column, s: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (vec_id, embedding,
    label); the anchors are the rows for which ``is_anchor``, a column over these, is true."""
    spark = vectors.sparkSession
    asks = F.coalesce(is_anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks")
    rows = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    rows = rows.select(*sent_ids(F.col("vec_id")), F.col("label").cast("long").alias("label"), asks, scaled(F.col("embedding"), s.scale).alias("cells"))
    cells = cells_of(rows)
    table = materialise(approximated(rows, cells), "approximations")
    path, some = new_path(spark, "negatives"), False
    for ids, labels, queries in blocks_of(table, s.block, cells.width):
        everything = np.full((1, len(ids)), ANY)
        block = Block(ids, labels, queries, -everything, everything)
        chosen = found_in(table, block, cells, s.positives, same=True).collect()
        positives = [[] for _ in ids]
        for r in sorted(chosen, key=lambda r: (r.anchor, r.rank)):
            positives[r.anchor].append((None if r.none else r.id, r.score))
        floor, ceiling = windows([[score for _, score in mine] for mine in positives], s)
        found = found_in(table, Block(ids, labels, queries, floor, ceiling), cells, s.negatives, same=False)
        named = [(a, slot, int(ids[a]), i, score) for a, mine in enumerate(positives) for slot, (i, score) in enumerate(mine)]
        names = spark.createDataFrame(named, "anchor long, slot int, anchor_id long, positive_id long, positive_score long")
        out = found.join(F.broadcast(names), ["anchor", "slot"])
        out = out.select("anchor_id", "positive_id", "rank", received_id().alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
        some = True
    return spark.read.schema(OUT).parquet(path) if some else spark.createDataFrame([], OUT)

"""Exact top-k search by inner product as a Voronoi kNN join.

**Groups.** ``pivots`` rows are taken by a hash; queries and data belong to the nearest. Against a pivot's direction a
vector has a part along it and a length across. One pass over the data gives, for each cell and each pivot, the range of
the parts along and the largest length across, and the cell's ``k`` rows nearest to its pivot; these few rows are scored
against all queries, so each query has a score that its k-th best reaches at least.

**Bounds.** A query group's summary is the range of its parts along its own pivot, its largest length across, and the
least score that all its queries are sure to reach. No row with part y along and length z across can score more than
``max(y * along) + z * across`` with a query of the group. Cells whose summary stays below the group's sure score are
left out whole; of the others only rows that can reach it are sent to the group.

**Units.** A large group of queries is dealt to blocks, a large cell (copies of one vector all lie in one) to pieces, by
a hash; a unit is a block and a piece, so no task gets more than a block and a piece, and solves them by one product of
matrices. A query's best of all units are ranked by a window function. How much is sent depends on how well the
data clusters: vectors without structure are sent to every block of queries, clustered ones to few.

**Defined cases.** Null vectors, and those with null or non-finite components, take no part. Components a vector lacks
count as 0. A row is no candidate of a query with its own id. Of rows that share a query's id one, the smallest vector,
is the query; as candidates repeated rows all count. Rows without an id are candidates, last on ties. Only vec_id and
embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import materialise
from .vectors import best, matrix, received_id, scaled, sent_ids, usable

OUT = "query_id long, rank int, vec_id long, score long"
NOTHING = -(1 << 62)
#: Scores found at a time.
SCORES = 1 << 22


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    k: int = 5
    pivots: int = 8
    #: Most queries of a unit, and most rows; a table has about ``pieces`` pieces at least.
    block: int = 32_768
    piece: int = 32_768
    pieces: int = 32


@dataclass(frozen=True)
class Pivots:
    vectors: np.ndarray

    @property
    def width(self) -> int:
        return self.vectors.shape[1]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row, the first on ties, and the squared distance."""
        far = np.stack([((rows - p).astype(float) ** 2).sum(1) for p in self.vectors])
        return far.argmin(0), far.min(0)

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Along each pivot's direction and across it, a column a pivot."""
        length = np.sqrt((self.vectors.astype(float) ** 2).sum(1))
        along = rows.astype(float) @ (self.vectors / np.maximum(length, 1)[:, None]).T
        across = np.sqrt(np.maximum((rows.astype(float) ** 2).sum(1)[:, None] - np.where(length > 0, along, 0) ** 2, 0))
        return along, across


@dataclass(frozen=True)
class Groups:
    """Summaries of the query groups, one number a pivot; a group without queries is sure of more than any score."""

    least: np.ndarray
    most: np.ndarray
    across: np.ndarray
    sure: np.ndarray

    def may_reach(self, least: np.ndarray, most: np.ndarray, across: np.ndarray) -> np.ndarray:
        """Whether rows with parts from ``least`` to ``most`` along and at most ``across`` can count in each group. The
        margin is wider than what rounding can take away."""
        ends = [a * b for a in (self.least, self.most) for b in (least, most)]
        bound = np.maximum.reduce(ends) + self.across * across
        return bound + 1 + 1e-9 * np.abs(bound) >= self.sure


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where that is exact, which is much faster."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    return (queries.astype(float) @ rows.astype(float).T).astype(np.int64) if most < 1 << 53 else queries @ rows.T


def dealt(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """``rows`` (id, none, asks, cells) with ``home``, the nearest pivot, and ``away``, the squared distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            home, away = pivots.nearest(matrix(batch["cells"], pivots.width))
            yield batch.assign(home=home, away=away)

    return rows.mapInPandas(run, "id long, none boolean, asks boolean, cells array<int>, home int, away double")


def cell_summaries(rows: DataFrame, pivots: Pivots) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By cell: its rows, and by pivot the least and largest part along and the largest across. A task sends a row for
    each cell and pivot."""
    n = len(pivots.vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(n, np.int64)
        least, most, across = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros((n, n))
        for batch in batches:
            y, z = pivots.parts(matrix(batch["cells"], pivots.width))
            home = batch["home"].to_numpy()
            np.add.at(count, home, 1)
            np.minimum.at(least, home, y)
            np.maximum.at(most, home, y)
            np.maximum.at(across, home, z)
        cell, pivot = (a.ravel() for a in np.indices((n, n)))
        out = pd.DataFrame({"home": cell, "pivot": pivot, "n": np.repeat(count, n), "least": least.ravel(), "most": most.ravel(), "across": across.ravel()})
        yield out[out["n"] > 0]

    each = rows.select("home", "cells").mapInPandas(run, "home int, pivot int, n long, least double, most double, across double")
    merged = each.groupBy("home", "pivot").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("across").alias("across"))
    out: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}
    for r in merged.collect():
        _, least, most, across = out.setdefault(r.home, (r.n, np.zeros(n), np.zeros(n), np.zeros(n)))
        least[r.pivot], most[r.pivot], across[r.pivot] = r.least, r.most, r.across
    return out


def nearest_rows(rows: DataFrame, k: int) -> list:
    """Of each cell the ``k`` rows nearest to its pivot."""
    order = W.partitionBy("home").orderBy("away", "none", "id", "cells")
    ranked = rows.select("home", "away", "none", "id", "cells").withColumn("nth", F.row_number().over(order))
    return ranked.where(F.col("nth") <= k).collect()


def asking(rows: DataFrame, pivots: Pivots, near: list, k: int) -> DataFrame:
    """The queries, one row an id: id, cells, home, along, across, sure (a score that the k-th best surely reaches)."""
    one = rows.where("asks").groupBy("id").agg(F.min("cells").alias("cells"), F.min_by("home", "cells").alias("home"))
    others, ids = matrix([r.cells for r in near], pivots.width), np.array([r.id for r in near], np.int64)
    none = np.array([r.none for r in near], bool)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, home = matrix(batch["cells"], pivots.width), batch["home"].to_numpy()
            along, across = (p[np.arange(len(home)), home] for p in pivots.parts(vectors))
            scores = products(vectors, others)
            scores[(batch["id"].to_numpy()[:, None] == ids) & ~none] = NOTHING
            sure = np.partition(scores, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(home), NOTHING)
            yield batch.assign(along=along, across=across, sure=sure)

    return one.mapInPandas(run, "id long, cells array<int>, home int, along double, across double, sure long")


def solve(queries: pd.DataFrame, rows: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """query, id, none, score: each query's best ``k`` of a unit's rows that reach its sure score."""
    out = []
    if len(queries) and len(rows):
        data, ids, none = matrix(rows["cells"], width), rows["id"].to_numpy(), rows["none"].to_numpy()
        step = max(1, SCORES // len(rows))
        for at in range(0, len(queries), step):
            some = queries.iloc[at : at + step]
            asked, sure = some["id"].to_numpy(), some["sure"].to_numpy()
            scores = products(matrix(some["cells"], width), data)
            scores[(asked[:, None] == ids) & ~none] = NOTHING
            if len(ids) > k:
                sure = np.maximum(sure, np.partition(scores, -k, axis=1)[:, -k])
            q, r = np.nonzero((scores >= sure[:, None]) & (scores > NOTHING))
            found = best(q, scores[q, r], none[r], ids[r], k)
            q, r = q[found], r[found]
            out.append(pd.DataFrame({"query": asked[q], "id": ids[r], "none": none[r], "score": scores[q, r]}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "none": [], "score": []}).astype({"query": "int64", "id": "int64", "none": "bool", "score": "int64"})


def part_of(key: Column, parts: list[int], first: list[int]) -> Column:
    """One of the ``parts[home]`` parts of a row's home, which are numbered from ``first[home]``, by a hash of ``key``."""
    of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("home") + 1)
    return (of(first) + F.pmod(F.xxhash64(key), of(parts))).cast("int")


def numbered(parts: list[int]) -> list[int]:
    return np.r_[0, np.cumsum(parts)[:-1]].tolist()


def nearest_neighbours(vectors: DataFrame, is_query: Column, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score of ``vectors`` (vec_id, embedding): the best ``k`` of each row for which
    ``is_query``, a column over vec_id, is true."""
    spark = vectors.sparkSession
    asks = F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks")
    taking_part = vectors.where(usable(F.col("embedding")))
    rows = taking_part.select(*sent_ids(F.col("vec_id")), asks, scaled(F.col("embedding"), s.scale).alias("cells"))
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 1
    chosen = rows.select("cells").orderBy(F.xxhash64("id", "cells"), "cells").limit(4 * s.pivots).collect()
    distinct = list(dict.fromkeys(tuple(r.cells) for r in chosen))[: s.pivots]
    if not distinct:
        return spark.createDataFrame([], OUT)
    pivots = Pivots(matrix(distinct, width))
    n = len(distinct)
    rows = materialise(dealt(rows, pivots), "dealt")
    cells = cell_summaries(rows, pivots)
    queries = materialise(asking(rows, pivots, nearest_rows(rows, s.k), s.k), "queries")
    summed = queries.groupBy("home").agg(
        F.count("*").alias("n"), F.min("along").alias("least"), F.max("along").alias("most"), F.max("across").alias("across"), F.min("sure").alias("sure")
    )
    summaries = {r.home: r for r in summed.collect()}
    if not summaries:
        return spark.createDataFrame([], OUT)
    of = lambda name, other: np.array([float(summaries[h][name]) if h in summaries else other for h in range(n)])
    groups = Groups(of("least", 0.0), of("most", 0.0), of("across", 0.0), of("sure", np.inf))
    needed = np.array([groups.may_reach(*cells[h][1:]) if h in cells else np.zeros(n, bool) for h in range(n)])
    blocks = [-(-summaries[h].n // s.block) if h in summaries else 0 for h in range(n)]
    size = min(s.piece, max(1, sum(c[0] for c in cells.values()) // s.pieces))
    pieces = [-(-cells[h][0] // size) if h in cells else 1 for h in range(n)]
    first_block, first_piece = numbered(blocks), numbered(pieces)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with the blocks of the groups in which they can count."""
        for batch in batches:
            y, z = pivots.parts(matrix(batch["cells"], width))
            useful = groups.may_reach(y, y, z) & needed[batch["home"].to_numpy()]
            sets, which = np.unique(useful, axis=0, return_inverse=True)
            to = [[first_block[g] + b for g in np.flatnonzero(u) for b in range(blocks[g])] for u in sets]
            yield batch.assign(blocks=[to[i] for i in which.ravel()])

    data = rows.select("id", "none", "cells", "home").mapInPandas(reach, "id long, none boolean, cells array<int>, home int, blocks array<int>")
    # Rows are dealt by their place in the table, so that repeated rows don't all meet in one piece.
    data = data.withColumn("piece", part_of(F.monotonically_increasing_id(), pieces, first_piece)).withColumn("block", F.explode("blocks"))
    reached = [[first_piece[c] + i for c in range(n) if needed[c, g] for i in range(pieces[c])] for g in range(n)]
    where = F.element_at(F.array(*(F.array(*map(F.lit, r)).cast("array<int>") for r in reached)), F.col("home") + 1)
    block = part_of(F.col("id"), [max(b, 1) for b in blocks], first_block)
    sent = queries.select("id", "cells", "sure", block.alias("block"), F.explode(where).alias("piece"))
    unit = (F.col("block").cast("long") * sum(pieces) + F.col("piece")).alias("unit")
    left = sent.select(unit, "id", "cells", "sure").groupBy("unit")
    right = data.select(unit, "id", "none", "cells").groupBy("unit")
    k = s.k
    found = left.cogroup(right).applyInPandas(lambda q, r: solve(q, r, width, k), "query long, id long, none boolean, score long")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "none", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", received_id().alias("vec_id"), "score")

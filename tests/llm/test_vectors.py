"""Clustering and searches over vectors, against plain Python, on fixtures with gaps, ties, copies and odd lengths."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession, functions as F

from rentmill.llm import lloyd, va_file, voronoi
from rentmill.llm.vectors import LARGEST

KIND = "vec_id long, embedding array<double>, label int, id string, cells int, home string, rank string, score string, cluster string, block string, none string"
Row = tuple[int | None, list[float | None] | None, int | None]


def made(seed: int, n: int, size: int, copies: int = 40) -> list[Row]:
    """Loose clusters, many copies of one vector, ties, and rows that take no part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows: list[Row] = []
    for i in range(n):
        c = rng.randrange(6)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in centres[c]], c if rng.random() < 0.9 else None))
    rows += [(n + i, list(rows[3][1]), 1 + i % 2) for i in range(copies)]
    rows += [(-50, [0.5] * size, 2), (-100, [0.0] * size, 2), (7000, [-1.0] * size, 1), (5000, None, 1), (5050, [], 3), (5100, [math.nan] * size, 1)]
    rows += [(5150, [math.inf] + [0.0] * (size - 1), 1), (5200, [None] + [1.0] * (size - 1), 1), (None, [0.9] * size, 1), (None, [0.8] * size, None)]
    return rows + [rows[5], rows[5], rows[0], (100, [1.0, 2.0], 0), (300, [0.1] * (size + 3), 4)]


def table(spark: SparkSession, rows: list[Row], parts: int = 5) -> DataFrame:
    return spark.createDataFrame([(*r, "x", 1, "x", "x", "x", "x", "x", "x") for r in rows], KIND).repartition(parts)


def whole(vector: list, factor: int) -> list[int]:
    return [max(-LARGEST, min(LARGEST, math.floor(max(-1e300, min(1e300, x * factor))))) for x in vector]


def fit(vector: list | None) -> bool:
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def product(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b, strict=False))


def last(x: int | None) -> tuple[bool, int]:
    return (x is None, x or 0)


def brute_lloyd(rows: list[Row], s: lloyd.Settings) -> list[tuple]:
    kept = [(i, whole(v, s.scale)) for i, v, _ in rows if fit(v) and len(v) == s.size]
    name = lambda i: hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: s.clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(s.rounds + 1):
        found = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if n < s.rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), f in zip(kept, found, strict=True) if f[1] == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = [sum(d for d, j in found if j == c) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia), names[j]) for (i, _), (d, j) in zip(kept, found, strict=True)]


@pytest.mark.parametrize("clusters", [1, 8, 500])
def test_lloyd(spark: SparkSession, clusters: int) -> None:
    rows = made(1, 150, 6)
    s = lloyd.Settings(clusters=clusters, size=6, rounds=4)
    got = lloyd.cluster(table(spark, rows), s)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_lloyd(rows, s), key=str)


def test_lloyd_far_components_and_empty_tables(spark: SparkSession) -> None:
    rows: list[Row] = [(1, [1e308, -1e308], 0), (2, [1e5, 3.0], 0), (1 << 62, [0.5, -0.5], 0), ((1 << 62) + 1, [0.5, -0.5], 0), (None, [0.0, 0.0], 0)]
    s = lloyd.Settings(clusters=2, size=2, rounds=3)
    assert sorted(map(tuple, lloyd.cluster(table(spark, rows), s).collect()), key=str) == sorted(brute_lloyd(rows, s), key=str)
    for none in ([], [(1, None, 1)], [(1, [1.0], 1)]):
        assert lloyd.cluster(table(spark, none), s).count() == 0
    with pytest.raises(ValueError, match="centroids"):
        lloyd.cluster(table(spark, rows), lloyd.Settings(clusters=1 << 20))


def brute_negatives(rows: list[Row], s: va_file.Settings) -> list[tuple]:
    kept = [(i, whole(v, s.scale), c) for i, v, c in rows if fit(v) and c is not None]
    anchors = {}
    for i, v, c in kept:
        if i is not None and i % 100 == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (label, v) in anchors.items():
        others = sorted(((-product(v, w), last(i), c) for i, w, c in kept if i != a))
        for score, i, _ in [o for o in others if o[2] == label][: s.positives]:
            fits = [o for o in others if o[2] != label and s.least * -score <= 100 * -o[0] <= s.most * -score]
            out += [(a, None if i[0] else i[1], n + 1, None if x[0] else x[1], -score, -z) for n, (z, x, _) in enumerate(fits[: s.negatives])]
    return out


@pytest.mark.parametrize(("seed", "size", "block"), [(2, 6, 4096), (3, 7, 2), (4, 1, 4096)])
def test_hard_negatives(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, seed: int, size: int, block: int) -> None:
    rows = made(seed, 420, size)
    s = va_file.Settings(block=block)
    got = va_file.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, s)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_negatives(rows, s), key=str)


def test_hard_negatives_far_components_and_empty_tables(spark: SparkSession) -> None:
    rows: list[Row] = [(0, [1e9, -2.0], 0), (1, [1e9, 1.0], 0), (2, [4e5, 1e300], 1), (3, [3e5, 2.0], 1), (4, [0.0, 0.0], 0), (100, [], 1), (200, [-1e308, 1.0], 1)]
    anchors = F.col("vec_id") % 100 == 0
    assert sorted(map(tuple, va_file.hard_negatives(table(spark, rows), anchors).collect())) == sorted(brute_negatives(rows, va_file.Settings()))
    for none in ([], [(0, None, 1)], [(0, [1.0], None)], [(1, [1.0], 1), (2, [1.0], 2)], [(0, [], 1), (1, [], 1), (2, [], 2)]):
        assert va_file.hard_negatives(table(spark, none), anchors).collect() == [tuple(r) for r in brute_negatives(none, va_file.Settings())]


def test_bounds_hold_and_rule_out() -> None:
    """Every score lies between its bounds, and most rows of clustered data can't enter a full window."""
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.integers(-300, 300, 16) + rng.integers(-40, 40, (500, 16)) for _ in range(6)])
    marks = np.quantile(rows, [i / va_file.CELLS for i in range(1, va_file.CELLS)], axis=0).astype(np.int64).T
    low = np.c_[np.minimum(rows.min(0), 0), marks + 1]
    high = np.c_[marks, np.maximum(rows.max(0), 0)]
    cells = va_file.Cells(low, high)
    codes, (lower, upper) = cells.codes(rows), cells.tables(rows[:9])
    exact = rows @ rows[:9].T
    lower, upper = va_file.look_up(codes, lower), va_file.look_up(codes, upper)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (upper >= np.partition(exact, -5, axis=0)[-5]).mean() < 0.05


def brute_neighbours(rows: list[Row], s: voronoi.Settings) -> list[tuple]:
    kept = [(i, whole(v, s.scale)) for i, v, _ in rows if fit(v)]
    queries: dict[int, list[int]] = {}
    for i, v in kept:
        if i is not None and i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        found = sorted((-product(v, w), last(i)) for i, w in kept if i != q)[: s.k]
        out += [(q, n + 1, None if i[0] else i[1], -score) for n, (score, i) in enumerate(found)]
    return out


@pytest.mark.parametrize(("seed", "size", "settings"), [
    (6, 6, voronoi.Settings()), (7, 5, voronoi.Settings(block=2, piece=7, pivots=5)), (8, 1, voronoi.Settings(pivots=1)), (9, 3, voronoi.Settings(k=400, pivots=40)),
])
def test_nearest_neighbours(spark: SparkSession, seed: int, size: int, settings: voronoi.Settings) -> None:
    rows = made(seed, 300, size)
    got = voronoi.nearest_neighbours(table(spark, rows), F.col("vec_id") % 50 == 0, settings)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_neighbours(rows, settings), key=str)


def test_nearest_neighbours_far_components_and_empty_tables(spark: SparkSession) -> None:
    rows: list[Row] = [(0, [1e9, -2.0], 0), (1, [1e9, 1.0], 0), (2, [4e5, 1e300], 1), (50, [], 1), (100, [-1e308, 1.0], 1), (None, [1e9, 1.0], 0)]
    asked = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, voronoi.nearest_neighbours(table(spark, rows), asked).collect()), key=str) == sorted(brute_neighbours(rows, voronoi.Settings()), key=str)
    for none in ([], [(0, None, 1)], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, [], 1), (1, [], 1)]):
        assert voronoi.nearest_neighbours(table(spark, none), asked).collect() == [tuple(r) for r in brute_neighbours(none, voronoi.Settings())]


def test_groups_rule_out_far_cells() -> None:
    """Rows that can't count in a group of queries aren't sent there."""
    pivots = voronoi.Pivots(np.array([[1000, 0, 0], [-1000, 0, 0]]))
    near, far = np.array([[990, 10, 5]]), np.array([[-980, 7, 3]])
    along, across = pivots.parts(near)
    groups = voronoi.Groups(along[0], along[0], across[0], np.array([900_000.0, np.inf]))
    assert groups.may_reach(*(p for p in (along, along, across))).tolist() == [[True, False]]
    y, z = pivots.parts(far)
    assert groups.may_reach(y, y, z).tolist() == [[False, False]]

"""Centroid clustering: plain Lloyd rounds over integer vectors.

Vectors with exactly ``size`` components, none null or non-finite, are scaled to integers and written once. Each round
sends the centroids to all tasks; a task takes integer squared differences to each centroid, the nearest (ties: the
smaller number), and sums components per centroid over its partition; these sums, one row a centroid and component from
each task, merge through ``groupBy``. Only the merged sums, ``clusters * (size + 3)`` numbers, come to the driver.

Start: the ``clusters`` vectors with the smallest SHA-256 of ``<seed>:<vec_id>`` (a null id reads as empty), on equal
hashes those with the smaller components; fewer vectors make fewer centroids. A centroid without vectors stays.
Without vectors the result is empty. Rows of one id or with one vector are separate rows. Components are exact up to
131,072 at the scale of 1024 (``vectors``); inertias beyond 64 bits are given as the largest 64-bit number. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import materialise
from .vectors import matrix, scaled, sent_ids, usable

OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
MOST = (1 << 63) - 1
#: Centroids are sent to every task, in at most so many bytes.
MOST_SENT = 64 << 20
#: Parts of a centroid's sums beside its components: its vectors, and their distances' low and high 32 bits.
COUNT, LOW, HIGH = -1, -2, -3


@dataclass(frozen=True)
class Settings:
    clusters: int = 8
    rounds: int = 10
    size: int = 64
    scale: int = 1024
    seed: str = "3"


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid, the smaller number on ties, and the squared distance."""
    far = np.empty((len(centroids), len(rows)), np.int64)
    for i, c in enumerate(centroids):
        differences = rows - c
        far[i] = np.einsum("ij,ij->i", differences, differences)
    found = far.argmin(0)
    return found, far[found, np.arange(len(rows))]


def sums(rows: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """What the vectors nearest to each centroid add up to, by (centroid, part)."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    size = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(sent.value)
        parts = np.arange(HIGH, size)
        total = np.zeros((k, len(parts)), np.int64)
        for batch in batches:
            values = matrix(batch["cells"], size)
            found, far = nearest(values, sent.value)
            for c in range(k):
                mine = found == c
                total[c, -HIGH:] += values[mine].sum(0)
                total[c, :-HIGH] += (far[mine] >> 32).sum(), (far[mine] & 0xFFFFFFFF).sum(), mine.sum()
        yield pd.DataFrame({"cluster": np.repeat(np.arange(k), len(parts)), "part": np.tile(parts, k), "total": total.ravel()})

    each = rows.select("cells").mapInPandas(run, "cluster int, part int, total long")
    merged = each.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sent.destroy()
    return {(r.cluster, r.part): int(r.total) for r in merged}


def moved(centroids: np.ndarray, total: dict[tuple[int, int], int]) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; one without vectors stays."""
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := total.get((c, COUNT), 0):
            out[c] = [total[c, i] // n for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per vector of ``vectors`` (vec_id, embedding) that takes part: vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256."""
    if s.clusters * s.size * 8 > MOST_SENT:
        raise ValueError(f"{s.clusters} centroids of {s.size} components are more than {MOST_SENT} bytes")
    spark = vectors.sparkSession
    taking_part = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == s.size))
    rows = materialise(taking_part.select(*sent_ids(F.col("vec_id")), scaled(F.col("embedding"), s.scale).alias("cells")), "vectors")
    named = F.concat(F.lit(f"{s.seed}:"), F.when(F.col("none"), "").otherwise(F.col("id").cast("string")))
    first = rows.select(F.sha2(named.cast("binary"), 256).alias("hash"), "cells").orderBy("hash", "cells").limit(s.clusters).collect()
    if not first:
        return spark.createDataFrame([], OUT)
    centroids = np.array([r.cells for r in first], np.int64)
    for _ in range(s.rounds):
        centroids = moved(centroids, sums(rows, centroids))
    total = sums(rows, centroids)
    own = [(total.get((c, HIGH), 0) << 32) + total.get((c, LOW), 0) for c in range(len(centroids))]
    inertias = np.array([min(x, MOST) for x in own], np.int64)
    whole = min(sum(own), MOST)
    names = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, far = nearest(matrix(batch["cells"], centroids.shape[1]), centroids)
            yield pd.DataFrame({
                "id": batch["id"], "none": batch["none"], "cluster": found, "distance": far,
                "cluster_inertia": inertias[found], "inertia": whole, "centroid_sha256": names[found],
            })

    kind = OUT.replace("vec_id long", "id long, none boolean")
    return rows.mapInPandas(run, kind).select(F.when(~F.col("none"), F.col("id")).alias("vec_id"), *(c.split()[0] for c in OUT.split(", ")[1:]))

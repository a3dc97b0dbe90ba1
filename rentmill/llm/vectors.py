"""Vectors as exact integers: which of them take part, their scaled components, and their ids on the way through Python.

Components are scaled and rounded down, x to floor(factor * x). They are exact up to ``LARGEST``; larger ones count as
that, so that squared differences and inner products of any usual number of components fit 64 bits.

A row without an id keeps its place among the candidates, after all ids on ties. pandas has no integers that may be
null, so ids travel as ``id`` and ``none``, whether there is none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

LARGEST = 1 << 27
NO_ID = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite. An empty vector is usable."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    return vector.isNotNull() & F.forall(vector, finite)


def scaled(vector: Column, factor: int) -> Column:
    """The integers of a usable vector, as array<int>."""
    bounded = lambda x: F.greatest(F.least(x.cast("double") * factor, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return F.transform(vector, lambda x: F.floor(bounded(x)).cast("int"))


def sent_ids(vec_id: Column) -> list[Column]:
    return [F.coalesce(vec_id.cast("long"), F.lit(NO_ID)).alias("id"), vec_id.isNull().alias("none")]


def received_id() -> Column:
    return F.when(~F.col("none"), F.col("id"))


def matrix(column: pd.Series | list, width: int) -> np.ndarray:
    """Rows of integers as int64; what a shorter vector lacks is 0, what a longer one has beyond ``width`` goes."""
    if len(column) and all(len(v) == width for v in column):
        return np.stack(list(column)).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        n = min(len(v), width)
        out[i, :n] = v[:n]
    return out


def best(keys: np.ndarray, scores: np.ndarray, none: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Indices of the first ``limit`` of each key: higher scores first, ties by smaller id, without an id last."""
    order = np.lexsort((ids, none, -scores, keys))
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < limit]

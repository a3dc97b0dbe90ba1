"""Substring dedup by difference-cover anchors.

A window is ``length`` consecutive words of one document. A word goes if it is covered by a window whose words also
start in a document of smaller doc_id, judged on the input.

1. Anchors are windows of ``length - period + 1`` words that start at positions whose remainder modulo the period is
   in a difference cover. Any two positions have a common shift below the period that takes both into the cover, so
   two equal windows of ``length`` words always share an anchor at the same place inside, while only
   len(COVER) / PERIOD of all positions are hashed and shuffled.
2. Anchors that occur in two documents are extended: all full windows around them become candidates, and only
   candidates' hashes are shuffled, to find the smallest document each occurs in.
3. Each chunk of documents marks its windows that a smaller document has, and drops the words these cover.

A chunk asks about each distinct hash with its smallest and its largest document only, so a passage that all
documents share costs two rows a chunk, and a hash's group has at most two rows a chunk. Windows are compared by
64-bit hashes of their words. Null texts have no words. A null doc_id counts as the largest. Documents with equal
doc_id don't remove each other's words. Extra columns stay, but for those the result names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from .chunks import CHUNK, NULLS, ORDER, chunk_count, chunk_of, dealt, unpacked
from .shared import small_batches
from .words import Words, covered

LENGTH = 13
#: A perfect difference set; every number modulo 7 but 0 is the difference of two of its members once.
PERIOD, COVER = 7, (0, 1, 3)


def _asked(hashes: np.ndarray, owners: np.ndarray) -> pa.Table:
    """The distinct hashes, each with its smallest and its largest owner."""
    order = np.argsort(hashes)
    hashes, owners = hashes[order], owners[order]
    first = np.nonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))[0] if len(hashes) else np.empty(0, np.int64)
    least = np.minimum.reduceat(owners, first) if len(first) else owners
    most = np.maximum.reduceat(owners, first) if len(first) else owners
    more = most > least
    return pa.table({
        "hash": np.concatenate((hashes[first], hashes[first][more])).view(np.int64),
        "doc": np.concatenate((least, most[more])),
    })


def _column(table: pa.Table, name: str) -> pa.Array:
    col = table.column(name).combine_chunks()
    return col.chunk(0) if isinstance(col, pa.ChunkedArray) else col


def _words(table: pa.Table) -> tuple[Words, np.ndarray]:
    parts = list(unpacked(table, 1 << 30))
    texts = pa.concat_arrays([p.column("text") for p in parts]) if parts else pa.array([], pa.string())
    return Words(texts), _column(table, ORDER).to_numpy()


def _anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    at, hashes = words.windows(length - PERIOD + 1)
    place = (at - words.starts[words.documents[at]]) % PERIOD
    chosen = np.isin(place, COVER)
    return at[chosen], hashes[chosen]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each value is in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept_text`` (the kept words, joined by one space), ``n_words`` and ``n_removed``."""
    if length < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    docs = docs.drop("kept_text", "n_words", "n_removed")
    small_batches(docs.sparkSession)
    count = chunk_count(docs)
    mine = dealt(docs, count)
    asked, names = "hash long, doc long", docs.columns

    def ask_anchors(table: pa.Table) -> pa.Table:
        words, order = _words(table)
        at, hashes = _anchors(words, length)
        return _asked(hashes, order[words.documents[at]])

    def ask_windows(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        words, order = _words(table)
        at, hashes = _anchors(words, length)
        known = np.unique(_column(shared, "hash").to_numpy()).view(np.uint64)
        known.sort()
        at = at[_among(hashes, known) >= 0]
        around = np.zeros(len(words) + 1, np.int64)
        np.add.at(around, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(around, at + 1, -1)
        candidate = np.cumsum(around)[:-1] > 0
        at, hashes = words.windows(length)
        chosen = candidate[at]
        return _asked(hashes[chosen], order[words.documents[at[chosen]]])

    def drop(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        words, order = _words(table)
        hashes = _column(found, "hash").to_numpy().view(np.uint64)
        known, first = np.unique(hashes, return_index=True)
        least = _column(found, "least").to_numpy()[first]
        at, own = words.windows(length)
        place = _among(own, known)
        hit = place >= 0
        hit[hit] = np.minimum(least[place[hit]], NULLS) < np.minimum(order[words.documents[at[hit]]], NULLS)
        gone = covered(at[hit], length, len(words))
        stays = np.nonzero(~gone)[0]
        kept = np.concatenate(([0], np.cumsum(~gone)))[words.starts]
        lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.vocabulary.take(pa.array(words.codes[stays])))
        n_words = words.counts
        texts = [p.column("text") for p in unpacked(table, 1 << 30)] if "text" in names else []
        out = pa.table({n: pa.chunked_array(texts, pa.string()) if n == "text" else table.column(n) for n in names})
        for name, values in (("kept_text", pc.binary_join(lists, " ")), ("n_words", n_words), ("n_removed", n_words - np.diff(kept))):
            out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values, pa.int64()))
        return out

    by_hash = W.partitionBy("hash")

    def shared(rows: DataFrame, everyone: bool) -> DataFrame:
        """Replies about hashes of two documents: to every chunk that asked, or only where a larger document did."""
        rows = rows.withColumns({"least": F.min("doc").over(by_hash), "most": F.max("doc").over(by_hash)})
        rows = rows.where("least < most" if everyone else "least < doc")
        return rows.select(chunk_of(F.col("doc"), count).alias(CHUNK), "hash", "least")

    anchors = shared(mine.groupBy(CHUNK).applyInArrow(ask_anchors, asked), everyone=True)
    windows = mine.groupBy(CHUNK).cogroup(anchors.select(CHUNK, "hash").groupBy(CHUNK)).applyInArrow(ask_windows, asked)
    schema = StructType([*docs.schema.fields]).add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return mine.groupBy(CHUNK).cogroup(shared(windows, everyone=False).groupBy(CHUNK)).applyInArrow(drop, schema)

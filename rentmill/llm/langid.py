"""Language identification by a byte convolutional network.

Filters of several widths slide over the UTF-8 bytes of fixed-length windows, each keeps its largest response in the
window, and a softmax layer turns the responses into languages. A text's windows cover it whole, without overlap;
its prediction is the softmax of their mean log-probabilities.

Training, in numpy on the driver, takes a bounded sample: at most ``rows`` labelled rows, evenly from all languages
and chosen by a hash of doc_id, and ``windows_per_row`` windows spread over each whole text, so at most
rows * windows_per_row * window bytes (6 MB as set) reach the driver. Of the labels the ``labels`` most frequent are
learned (by name where they tie); rows with others are not learned from. Prediction is one narrow pass; a task holds one
slice of 8 MB of text, or one document. The broadcast weights have a fixed size.

Texts that are null or without a letter get ``und`` and the score 0, as do all where nothing could be learned. Rows
without label are not learned from. Repeated rows are judged alike. Extra columns stay, but for those the result names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .words import slices, text_bytes


#: Windows that are looked at together.
BLOCK = 4096


@dataclass(frozen=True)
class Settings:
    rows: int = 4000
    labels: int = 256
    windows_per_row: int = 6
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    epochs: int = 6
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    languages: list[str]
    #: For each width, (width, 256, filters): a filter's response to each byte at each place.
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    window: int


class Windows:
    """The windows of many texts, the last ones filled up with zero bytes; ``counts`` of each text, its index in
    ``owner``. They are cut when asked for, a block at a time: a text of any size takes little more than its bytes."""

    def __init__(self, col: pa.StringArray, size: int) -> None:
        self.size = size
        self.data, offsets = text_bytes(col)
        self.counts = -(-np.diff(offsets) // size)
        self.owner = np.repeat(np.arange(len(col)), self.counts)
        first = np.cumsum(self.counts) - self.counts
        self.start = offsets[:-1][self.owner] + (np.arange(len(self.owner)) - first[self.owner]) * size
        self.end = np.minimum(self.start + size, offsets[1:][self.owner])

    def __len__(self) -> int:
        return len(self.owner)

    def cut(self, which: np.ndarray | slice) -> np.ndarray:
        start, end = self.start[which], self.end[which]
        if not len(start):
            return np.zeros((0, self.size), np.uint8)
        at = start[:, None] + np.arange(self.size)
        return np.where(at < end[:, None], self.data[np.minimum(at, len(self.data) - 1)], 0).astype(np.uint8)


def responses(net: Network, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each filter's largest response in each window, and, if asked for, its place."""
    best, places = [], []
    for table in net.filters:
        width = len(table)
        n = x.shape[1] - width + 1
        h = table[0][x[:, :n]]
        for k in range(1, width):
            h += table[k][x[:, k : n + k]]
        if where:
            place = h.argmax(axis=1)
            places.append(place)
            best.append(np.take_along_axis(h, place[:, None, :], 1)[:, 0])
        else:
            best.append(h.max(axis=1))
    return np.concatenate(best, axis=1), places


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, languages: list[str], s: Settings) -> Network:
    """Adam on the cross entropy. A pooled response passes its gradient on to the place it came from."""
    rng = np.random.default_rng(s.seed)
    total, n = s.filters * len(s.widths), len(languages)
    filters = [rng.normal(0, 0.3, (w, 256, s.filters)).astype(np.float32) for w in s.widths]
    net = Network(languages, filters, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, n)).astype(np.float32), np.zeros(n, np.float32), s.window)
    params = [*net.filters, net.bias, net.weights, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(x))
        rate = s.rate * (1 - epoch / s.epochs)
        for k in range(0, len(x), s.batch):
            rows = order[k : k + s.batch]
            xb, yb = x[rows], y[rows]
            pooled, places = responses(net, xb, where=True)
            hidden = np.maximum(pooled + net.bias, 0)
            error = np.exp(log_softmax(hidden @ net.weights + net.offset))
            error[np.arange(len(rows)), yb] -= 1
            error /= len(rows)
            back = (error @ net.weights.T) * (hidden > 0)
            grads = []
            for i, place in enumerate(places):
                own = back[:, i * s.filters : (i + 1) * s.filters]
                grad = np.zeros_like(net.filters[i])
                for j in range(len(grad)):
                    at = xb[np.arange(len(rows))[:, None], place + j].astype(np.int64) * s.filters + np.arange(s.filters)
                    grad[j] = np.bincount(at.ravel(), weights=own.ravel(), minlength=256 * s.filters).reshape(256, s.filters)
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Predictor:
    """The network with its tables merged for pairs of neighbouring bytes, which halves the look-ups."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.steps: list[list[tuple[int, bool, np.ndarray]]] = []
        for table in net.filters:
            steps, k = [], 0
            while k < len(table):
                if k + 1 < len(table):
                    pair = (table[k][:, None, :] + table[k + 1][None, :, :]).reshape(65536, -1)
                    steps.append((k, True, pair))
                    k += 2
                else:
                    steps.append((k, False, table[k]))
                    k += 1
            self.steps.append(steps)

    def log_probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        net, out = self.net, []
        for k in range(0, len(x), block):
            one = x[k : k + block].astype(np.intp)
            two = one[:, :-1] * 256 + one[:, 1:]
            best = []
            for table, steps in zip(net.filters, self.steps, strict=True):
                n = one.shape[1] - len(table) + 1
                h = None
                for at, paired, values in steps:
                    part = np.take(values, (two if paired else one)[:, at : at + n], axis=0)
                    h = part if h is None else np.add(h, part, out=h)
                best.append(h.max(axis=1))
            hidden = np.maximum(np.concatenate(best, axis=1) + net.bias, 0)
            out.append(log_softmax(hidden @ net.weights + net.offset))
        return np.concatenate(out) if out else np.zeros((0, len(net.languages)), np.float32)

    def predict(self, col: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Index and probability of each text's language; texts without a byte get index 0."""
        windows = Windows(col, self.net.window)
        total = np.zeros((len(col), len(self.net.languages)))
        for k in range(0, len(windows), BLOCK):
            some = slice(k, k + BLOCK)
            np.add.at(total, windows.owner[some], self.log_probabilities(windows.cut(some)))
        mean = total / np.maximum(windows.counts, 1)[:, None]
        return mean.argmax(axis=1), np.exp(log_softmax(mean).max(axis=1))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(labelled: DataFrame, settings: Settings = Settings()) -> Network | None:
    """Train on a bounded sample of ``labelled`` (doc_id, text, lang); None if no row has a label and a letter."""
    s = settings
    sizes = labelled.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.labels)
    counts = {r.lang: r["count"] for r in sizes.collect()}
    if not counts:
        return None
    each = max(1, s.rows // len(counts))
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))))
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.withColumn("_rm_place", place).where((place < share) & has_letter(F.col("text")))
    sample = sample.orderBy("_rm_place", "doc_id", "lang").limit(s.rows).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                windows = Windows(part.column("text"), s.window)
                n = windows.counts
                first = np.cumsum(n) - n
                picks = [np.unique(np.linspace(0, k - 1, min(k, s.windows_per_row)).astype(int)) + f for f, k in zip(first, n, strict=True)]
                rows = np.repeat(np.arange(len(n)), [len(p) for p in picks])
                chosen = windows.cut(np.concatenate(picks)) if picks else []
                data = pa.array([x.tobytes() for x in chosen], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(rows)) for c in ("doc_id", "lang")] + [data], ["doc_id", "lang", "data"])

    found = sample.mapInArrow(cut, StructType([labelled.schema["doc_id"], labelled.schema["lang"]]).add("data", "binary")).toArrow()
    found = found.take(pc.sort_indices(found, [("doc_id", "ascending"), ("data", "ascending")]))
    languages = sorted(counts)
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found["data"].to_pylist()), np.uint8).reshape(found.num_rows, s.window)
    y = np.array([languages.index(v) for v in found["lang"].to_pylist()])
    return train(x, y, languages, s)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred string and score double."""
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model.value)
        names = pa.array(predictor.net.languages, pa.string())
        for batch in batches:
            for part in slices(batch):
                found, score = predictor.predict(pc.fill_null(part.column("text"), ""))
                new = [names.take(pa.array(found)), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.fieldNames())

    worded = F.col("_rm_letter")
    out = docs.withColumn("_rm_letter", has_letter(F.col("text")))
    schema = StructType([*out.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    out = out.mapInArrow(run, schema)
    return out.withColumns({
        "lang_pred": F.when(worded, F.col("lang_pred")).otherwise("und"),
        "score": F.when(worded, F.col("score")).otherwise(0.0),
    }).drop("_rm_letter")

"""Scoring texts with a language model: prediction by partial matching over bytes, and a word-count base.

Both models are pretrained on the training rows. The byte model is a trie of contexts of up to ``ORDER`` bytes. A
symbol seen in the longest context has probability count / (total + kinds); otherwise the code escapes with
kinds / (total + kinds) to the next shorter context, where the symbols of the longer one are excluded from counts,
total and kinds, and so down to a uniform choice among symbols never seen. A text's score is the sum of log10
probabilities of its bytes (A-Z lower-cased) and of one end symbol.

The trie is a distributed table, as large as the corpus makes it:

1. Each task counts the words and (ORDER + 1)-grams of its documents; a map-side combined aggregate gives one row an
   item: its occurrences in training rows.
2. Grams are dealt by the last two bytes of their context, so all contexts of two bytes or more that share them meet
   in one task, which walks the trie for each gram in numpy. Where more than ``GROUP`` grams share two bytes they are
   dealt by three, and so on up to the whole context: groups stay bounded as the corpus grows. What such a group lacks,
   the counts after the shorter contexts that were divided, meets it by a join on the context: 257 for each length at
   most. The divided contexts themselves are broadcast, one number for each GROUP grams of the corpus and length at
   most (10^11 grams: 25,000 numbers); and so are counts of single bytes after a single byte, 258 * 257 at most.
3. Chunks of documents ask for the value of each distinct word and gram they contain (see ``chunks``), by a join on
   the item; replies meet the texts by chunk, where values are gathered and summed.

Words are compared by 63-bit hashes. Null texts count as empty: no words, one end. Without any training row each
symbol is one of 257. Repeated rows count and are scored each. Extra columns stay, but for those the result names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .chunks import CHUNK, chunk_count, dealt, unpacked
from .shared import materialise, small_batches
from .words import U64, Words, slices, text_bytes

ORDER, BITS = 5, 9
SYMBOLS, END, START = 257, 256, 257
SLICE_BYTES, HELD, CHUNK_BYTES = 2 << 20, 1_000_000, 16 << 20
#: Buckets at least, and grams of a bucket, about; grams with the same end of their contexts that are not divided.
BUCKETS, BUCKET, GROUP = 1024, 1_000_000, 4_000_000


def low(keys: np.ndarray, symbols: int) -> np.ndarray:
    """The last ``symbols`` symbols of each key."""
    return keys & ((1 << (BITS * symbols)) - 1)


def grams(col: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (ORDER + 1)-grams that end at each byte of all texts, those at the end of each text, and the number of
    bytes of each text."""
    data, offsets = text_bytes(pc.ascii_lower(col))
    lengths = np.diff(offsets)
    symbols = data.astype(np.int64)
    keys = symbols.copy()
    for k in range(1, ORDER + 1):
        keys[k:] |= symbols[:-k] << (BITS * k)
    before = sum(START << (BITS * k) for k in range(ORDER + 1))
    for k in range(ORDER):  # what precedes a text is START
        at = offsets[:-1][lengths > k] + k
        keys[at] = low(keys[at], k + 1) | (before & ~((1 << (BITS * (k + 1))) - 1))
    last = np.full(len(col), before, np.int64)
    last[lengths > 0] = keys[offsets[1:][lengths > 0] - 1]
    return keys, low(last << BITS, ORDER + 1) | END, lengths


def word_keys(words: Words) -> np.ndarray:
    """A negative key for each word; keys of grams aren't negative."""
    return (words.hashes | U64(1 << 63)).view(np.int64)


def coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the index of each key among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts; sorting numbers is several times faster than hashing them."""
    keys = np.sort(keys)
    starts = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, codes = coded(keys)
    return distinct, np.bincount(codes, weights=counts, minlength=len(distinct)).astype(np.int64)


def count_items(docs: DataFrame) -> DataFrame:
    """key, n: occurrences in rows with ``train`` of every word and gram of ``docs`` (text, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return tally(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def hold(keys: np.ndarray, train: np.ndarray) -> None:
            held.append(distinct(keys[train]))
            others = distinct(keys[~train])[0]
            held.append((others, np.zeros(len(others), np.int64)))

        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                text = pc.fill_null(part.column("text"), "")
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                words = Words(text, lower=True)
                hold(word_keys(words), train[words.documents])
                keys, ends, counts = grams(text)
                hold(np.concatenate((keys, ends)), np.concatenate((np.repeat(train, counts), train)))
            if sum(len(k) for k, _ in held) > HELD:
                held[:] = [joined()]
                if len(held[0][0]) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], ["key", "n"])

    return docs.select("text", "train").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Short:
    """Contexts of one byte and of none, as dense counts[context, symbol]."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.one = np.zeros((START + 1, SYMBOLS), np.int64)
        np.add.at(self.one, (keys >> BITS, low(keys, 1)), counts)
        self.none = self.one.sum(axis=0)


def find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return np.where(known[at] == keys, at, -1) if len(known) else np.full(len(keys), -1)


def find_many(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``find`` for many keys in any order; looked up in order, they meet the cache."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = find(known, keys[order])
    return out


def walk(keys: np.ndarray, counts: np.ndarray, depths: np.ndarray, after: dict[int, tuple[np.ndarray, np.ndarray]], short: Short) -> np.ndarray:
    """log10 probability of each gram's last symbol after the others. ``keys`` hold all grams, with their ``counts``
    in training, that are dealt by the same ends of their contexts; ``depths`` are the lengths of these ends, and
    ``after`` has, for shorter lengths, the counts of the symbols after divided ends (keys, counts)."""
    values = np.zeros(len(keys))
    todo = np.ones(len(keys), bool)
    out_total, out_kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)

    def step(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, shorter: np.ndarray) -> None:
        """One context: of those still to do, code the symbols it has seen and escape from the others."""
        left = kinds - out_kinds
        whole = total - out_total + left
        hit = todo & (count > 0)
        miss = todo & ~hit & (left > 0)
        values[hit] += np.log10(count[hit] / whole[hit])
        values[miss] += np.log10(left[miss] / whole[miss])
        todo[hit] = False
        seen = kinds > 0
        out_total[seen], out_kinds[seen] = shorter[seen], kinds[seen]

    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(ORDER, 1, -1):
        # Counts after contexts that lie here whole are added up, those after divided ones are given.
        whole = (counts > 0) & (depths <= k)
        own, where = np.unique(low(keys[whole], k + 1), return_inverse=True)
        n = np.bincount(where, weights=counts[whole], minlength=len(own)).astype(np.int64)
        if k in after:
            own, n = np.concatenate((own, after[k][0])), np.concatenate((n, after[k][1]))
            order = np.argsort(own)
            own, n = own[order], n[order]
        levels[k] = own, n
    for k in range(ORDER, 1, -1):
        own, n = levels[k]
        suffix = low(own, k)
        if k > 2:
            below = levels[k - 1][1][find(levels[k - 1][0], suffix)] if len(own) else n
        else:
            below = short.one[suffix >> BITS, low(suffix, 1)]
        contexts, where = np.unique(own >> BITS, return_inverse=True)
        total, kinds, shorter = (np.bincount(where, weights=w, minlength=len(contexts)).astype(np.int64) for w in (n, np.ones(len(n)), below))
        at, place = find(own, low(keys, k + 1)), find(contexts, low(keys, k + 1) >> BITS)
        pick = lambda values, at: np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(at), np.int64)
        step(pick(n, at), pick(total, place), pick(kinds, place), pick(shorter, place))
    symbol, last = low(keys, 1), low(keys, 2) >> BITS
    one, none = short.one, short.none
    step(one[last, symbol], one.sum(axis=1)[last], (one > 0).sum(axis=1)[last], ((one > 0) @ none)[last])
    full = lambda n: np.full(len(keys), n)
    step(none[symbol], full(none.sum()), full((none > 0).sum()), full(0))
    values[todo] -= np.log10(max(1, SYMBOLS - int((none > 0).sum())))
    return values


def tail(symbols: int) -> Column:
    """The last symbols of the column ``key``."""
    return F.col("key").bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def marked(rows: DataFrame, k: int, ends: list[int]) -> DataFrame:
    """``rows`` with ``divided``, true where the last ``k`` symbols of the context are one of ``ends``."""
    known = rows.sparkSession.createDataFrame([(e,) for e in ends], "end long").withColumn("divided", F.lit(True))
    return rows.withColumn("end", F.shiftrightunsigned(tail(k + 1), BITS)).join(F.broadcast(known), "end", "left").drop("end")


def divide(items: DataFrame) -> tuple[dict[int, list[int]], int]:
    """For each length the ends of contexts of which ``items`` (key, n) have more than GROUP grams, and a number of
    buckets. At most one end a length for each GROUP grams reaches the driver; of two symbols all, 258 * 258 at most."""
    divided: dict[int, list[int]] = {}
    rows, total = items, 0
    for k in range(2, ORDER):
        end = F.shiftrightunsigned(tail(k + 1), BITS)
        sizes = rows.groupBy(end.alias("end")).agg(F.count("*").alias("size"))
        if k == 2:
            found = sizes.collect()
            total = sum(r["size"] for r in found)
        else:
            found = sizes.where(F.col("size") > GROUP).collect()
        ends = sorted(r.end for r in found if r["size"] > GROUP)
        if not ends:
            break
        rows = marked(rows, k, ends).where("divided").drop("divided")
        divided[k] = ends
    return divided, max(BUCKETS, math.ceil(total / BUCKET))


def grouped(rows: DataFrame, divided: dict[int, list[int]], buckets: int) -> DataFrame:
    """``rows`` (key, n) with ``depth``, the length of the end of its context by which a gram is dealt, ``end``, this end,
    and ``bucket``."""
    rows = rows.withColumns({"depth": F.lit(2), "group": F.shiftrightunsigned(tail(3), BITS)})
    for k, ends in divided.items():
        longer = F.shiftrightunsigned(tail(k + 2), BITS)
        rows = marked(rows, k, ends).withColumns({
            "depth": F.when(F.col("divided"), k + 1).otherwise(F.col("depth")), "group": F.when(F.col("divided"), longer).otherwise(F.col("group")),
        }).drop("divided")
    return rows.withColumn("bucket", F.pmod(F.hash("group"), F.lit(buckets)))


def shorter_counts(rows: DataFrame, divided: dict[int, list[int]]) -> DataFrame:
    """bucket, depth, key, n: for each bucket of ``grouped`` rows the counts of the symbols after the divided ends of its
    grams' contexts, keyed by end and symbol."""
    kind = "bucket int, depth int, key long, n long"
    if not divided:
        return rows.sparkSession.createDataFrame([], kind)
    groups = rows.where("depth > 2").select("bucket", "group", "depth").distinct()
    ends = groups.select("bucket", "group", F.explode(F.sequence(F.lit(2), F.col("depth") - 1)).alias("depth"))
    wanted = ends.select("bucket", "depth", F.expr(f"group & (shiftleft(1L, {BITS} * depth) - 1)").alias("end")).distinct()
    after = None
    for k in divided:
        counts = rows.where((F.col("depth") > k) & (F.col("n") > 0)).groupBy(tail(k + 1).alias("key")).agg(F.sum("n").alias("n"))
        counts = counts.select(F.lit(k).alias("depth"), F.shiftrightunsigned("key", BITS).alias("end"), "key", "n")
        after = counts if after is None else after.unionByName(counts)
    found = wanted.join(after, ["depth", "end"])
    return found.select(F.col("bucket").alias("bucket"), *(F.col(c).alias(c) for c in ("depth", "key", "n")))  # apart from those of ``rows``


def score(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, train, ...) with n_tokens, n_known, train_tokens, base_score and score."""
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = docs.withColumn("train", F.coalesce("train", F.lit(False)))
    small_batches(docs.sparkSession)
    items = materialise(count_items(docs), "items")
    ends = docs.where("train").count()
    facts = items.where("key < 0 AND n > 0").agg(F.sum("n"), F.count("*")).first()
    train_tokens, kinds = (facts[0] or 0) + ends, facts[1] + (ends > 0)
    grams_ = items.where("key >= 0")
    pairs = grams_.where("n > 0").groupBy(tail(2).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    divided, buckets = divide(grams_)
    table = Short(*(pairs.column(c).to_numpy().astype(np.int64) for c in ("key", "n")))
    short = docs.sparkSession.sparkContext.broadcast(table)

    def price(table: pa.Table, more: pa.Table) -> pa.Table:
        keys, n, depths = (table.column(c).to_numpy() for c in ("key", "n", "depth"))
        level, ends, counts = (more.column(c).to_numpy() for c in ("depth", "key", "n"))
        after = {int(k): (ends[level == k], counts[level == k]) for k in np.unique(level)}
        return pa.table({"key": keys, "value": walk(keys, n, depths, after, short.value)})

    rows = grouped(grams_, divided, buckets)
    mine, lacking = (x.select("bucket", "depth", "key", "n").groupBy("bucket") for x in (rows, shorter_counts(rows, divided)))
    trie = mine.cogroup(lacking).applyInArrow(price, "key long, value double")
    lexicon = items.where("key < 0 AND n > 0").select("key", F.col("n").cast("double").alias("value"))
    known = lexicon.unionByName(trie)

    count = chunk_count(docs, chunk_bytes=CHUNK_BYTES)
    mine = dealt(docs, count, by=F.xxhash64("doc_id", "text"))
    names = docs.columns

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column(CHUNK)[0].as_py()
        found = []
        for part in unpacked(table, SLICE_BYTES):
            text = pc.fill_null(part.column("text"), "")
            found += [distinct(word_keys(Words(text, lower=True)))[0], distinct(np.concatenate(grams(text)[:2]))[0]]
        keys = distinct(np.concatenate(found))[0]
        return pa.table({CHUNK: pa.array(np.full(len(keys), chunk, np.int32)), "key": keys})

    known_end = float(np.log10(ends + 1))
    token_cost = float(np.log10(train_tokens + kinds + 1))
    schema = StructType([*docs.schema.fields])
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def add_up(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        keys, values = (replies.column(c).to_numpy() for c in ("key", "value"))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        parts = []
        for part in unpacked(table, SLICE_BYTES):
            text = pc.fill_null(part.column("text"), "")
            words = Words(text, lower=True)
            own, codes = coded(word_keys(words))
            at = find_many(keys, own)
            c = np.where(at >= 0, values[at], 0.0)[codes] if len(keys) else np.zeros(len(codes))
            per = lambda x, n=part.num_rows, d=words.documents: np.bincount(d, weights=x, minlength=n)
            n_tokens = words.counts + 1
            base = per(np.log10(c + 1)) + known_end - n_tokens * token_cost
            inner, last, lengths = grams(text)
            own, codes = coded(np.concatenate((inner, last)))
            found = values[find_many(keys, own)][codes]
            total = found[len(inner) :].copy()
            some = lengths > 0
            if some.any():
                total[some] += np.add.reduceat(found[: len(inner)], (np.cumsum(lengths) - lengths)[some])
            new = [n_tokens, (per(c > 0) + (ends > 0)).astype(np.int64), np.full(part.num_rows, train_tokens), base, total]
            parts.append(pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *map(pa.array, new)], schema.fieldNames()))
        return pa.Table.from_batches(parts)

    asked = mine.groupBy(CHUNK).applyInArrow(ask, f"{CHUNK} int, key long")
    replies = asked.join(known, "key").select(CHUNK, "key", "value")
    return mine.groupBy(CHUNK).cogroup(replies.groupBy(CHUNK)).applyInArrow(add_up, schema)

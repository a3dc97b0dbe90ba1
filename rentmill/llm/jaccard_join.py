"""N-gram Jaccard join with PartEnum signatures: all links counted, and connected components.

A document's set is its distinct shingles of five lower-cased words (64-bit hashes; of a shorter document, the whole
sequence). Two sets link when their Jaccard similarity is at least ``LEVEL`` percent. Sets are compared as classes of
equal sets, named by 63-bit fingerprints.

**Signatures.** Sizes are cut into bands, each ending a quarter above the one before, so linked sets lie in the same
or in neighbouring bands; group g is bands g and g + 1. Linked sets of a group, the smaller of them in band g, differ
in at most k = r // 4 elements (r: band g's largest size). The hash domain is cut on two levels: into more than k / 2
partitions, and each of these into three parts. One partition at least holds at most one of the differing elements, so
two of its three parts are equal in both sets: of each partition all subsets of two parts are enumerated, and the
elements of each subset that isn't empty, hashed, are a signature.

A pair shares no signature only if all its equal subsets are empty. A partition whose elements lie in two parts or
three then holds two differing elements, one whose elements lie in one part holds one; so twice the number of the
former plus the number of the latter is at most k, for either set. Sets for which that holds also emit each of their
elements, in the group, as a signature; linked sets share elements.

Elements that very many documents share (found by counting all elements, Misra-Gries) would make signatures that very
many classes share. They are left out: sets differ no more without them, so all of the above holds of what is left.
Only a set for which the sum above is at most k without them emits the signatures of its whole set as well. Which
elements are left out changes the work, never the result.

**Candidates.** Of each signature's classes, each is paired with the first and with the one before it: all pairs up
to three classes. Larger buckets are kept; once the pairs have been joined to components, buckets whose classes are
not yet in one component are looked into, in blocks of ``BLOCK`` classes, for pairs across components. A sketch of
parities is exact one way: sets that differ in d elements differ in at most d parities, so pairs with more than
(a + b) / 9 different parities are no links and are dropped. A sketch has two to four parities an element, 1,024 at
least, so that it tells sets of any size apart; of sketches of different sizes the larger is folded, half onto half. A
component of what is left holds every link of its sets.

**Check.** The texts of each component, one a class, meet in one task (large components: in pairs of blocks), where
sets are compared exactly. ``near_links`` compares all pairs and counts links; ``near_duplicates`` only searches each
component breadth first, which visits near copies of each other once. Either way a task yields just the links that
hold its sets together, and components of these links are the result; no table of all pairs is made. Texts travel
once a block, and only those of a fixed-size bitmap of the classes that are needed.

A class that has many copies is signed where its first text is, not once a copy. Null and empty texts have the empty
set and link with nothing. Repeated rows form a class. A null doc_id's document takes part, but doesn't name a
component unless alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .components import components
from .shared import content_hash, materialise, row_keys, small_batches
from .words import U64, Words, mix, slices

WORDS, LEVEL = 5, 80
LEAST_SKETCH, BLOCK, NEEDED_BITS = 1024, 1000, 1 << 23
#: Shingles of a block of classes that are compared with each other, about.
BLOCK_ELEMENTS = 1 << 20
PARTS = 3
#: Bounds of what is broadcast: elements left out of signatures, and classes of many copies.
COMMON, COMMON_SHARE, HOT_CLASSES, HOT_COPIES = 4096, 1000, 10_000, 100
#: Signatures that a task holds at a time, about.
HELD = 1 << 18
SALT = U64(0xD6E8FEB86659FD93)


def salted(n: np.ndarray | int) -> np.ndarray:
    """A different number for each ``n``."""
    return np.atleast_1d(np.asarray(n)).astype(U64) * SALT


def band_ends(size: int) -> list[int]:
    """The largest sizes of the bands up to the one of ``size``."""
    ends = [1]
    while ends[-1] < size:
        ends.append(max(ends[-1] + 1, ends[-1] * 5 // 4))
    return ends


class Sets:
    """The shingle sets of many texts: ``elements``, sorted within each set, one set after the other, and ``sizes``."""

    def __init__(self, elements: np.ndarray, sizes: np.ndarray) -> None:
        self.elements, self.sizes = elements, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of_texts(cls, col: pa.Array) -> Sets:
        words = Words(pc.fill_null(col, ""), lower=True)
        at, hashes = words.windows(WORDS)
        counts = words.counts
        per = np.maximum(counts - WORDS + 1, 0)
        short = np.nonzero((counts > 0) & (counts < WORDS))[0]
        per[short] = 1
        edges = np.concatenate(([0], np.cumsum(per)))
        elements = np.empty(edges[-1], U64)
        alone = edges[:-1][short]
        inside = np.ones(len(elements), bool)
        inside[alone] = False
        elements[inside] = hashes
        if len(short):
            elements[alone] = mix(words.spans(words.starts[short], counts[short]) ^ salted(counts[short]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            elements[a:b].sort()
        owner = np.repeat(np.arange(len(per)), per)
        new = np.ones(len(elements), bool)
        new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
        return cls(elements[new], np.bincount(owner[new], minlength=len(per)))

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.elements[self.starts[i] : self.starts[i] + self.sizes[i]]

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)

    def take(self, chosen: np.ndarray) -> Sets:
        """The chosen sets, by index in ascending order."""
        mine = np.zeros(len(self), bool)
        mine[chosen] = True
        return Sets(self.elements[np.repeat(mine, self.sizes)], self.sizes[chosen])

    def without(self, common: np.ndarray) -> Sets:
        """The sets without the elements of the sorted ``common``."""
        if not len(common) or not len(self.elements):
            return self
        at = np.minimum(np.searchsorted(common, self.elements), len(common) - 1)
        rare = common[at] != self.elements
        return Sets(self.elements[rare], np.bincount(self.owners[rare], minlength=len(self)))

    def fingerprints(self) -> np.ndarray:
        """63 bits of each set; those of empty sets mean nothing."""
        sums = np.zeros(len(self), U64)
        some = np.nonzero(self.sizes)[0]
        if len(some):
            sums[some] = np.add.reduceat(mix(self.elements ^ SALT), self.starts[some])
        return (mix(sums ^ salted(self.sizes)) >> U64(1)).view(np.int64)

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """Parities of each set, 64 in a number, one set's after the other's; and how many numbers each set has."""
        doublings = np.ceil(np.log2(np.maximum(self.sizes * 2 / LEAST_SKETCH, 1))).astype(np.int64)
        words = (LEAST_SKETCH // 64) << doublings
        owners = self.owners
        bits = mix(self.elements + SALT) & ((words * 64 - 1).astype(U64))[owners]
        out = np.zeros(int(words.sum()), U64)
        np.bitwise_xor.at(out, (np.cumsum(words) - words)[owners] + (bits >> U64(6)).astype(np.int64), U64(1) << (bits & U64(63)))
        return out.view(np.int64), words


def subsets(sets: Sets, groups: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all subsets of two parts of each partition of each set, for its group and limit k, and the index of
    the set of each; and for each set whether these could miss a link."""
    n1 = limits // 2 + 2 + (limits * 3 + 99) // 100
    first = np.cumsum(n1) - n1
    high = (sets.elements >> U64(32)).astype(np.int64)
    owners = sets.owners
    place = first[owners] * PARTS + ((high * (n1 * PARTS)[owners]) >> 32)
    sums, full = np.zeros(int(n1.sum()) * PARTS, U64), np.zeros(int(n1.sum()) * PARTS, bool)
    if len(place):
        starts = np.nonzero(np.diff(place, prepend=-1))[0]
        sums[place[starts]] = np.add.reduceat(mix(sets.elements), starts)
        full[place[starts]] = True
    sums, full = sums.reshape(-1, PARTS), full.reshape(-1, PARTS)
    kinds = full.sum(axis=1)
    of = np.repeat(np.arange(len(sets)), n1)
    spread = np.bincount(of, weights=np.minimum(kinds, 2), minlength=len(sets))
    partition = np.arange(len(of)) - first[of]
    name = mix((groups[of] << 32 | partition).astype(U64) * U64(PARTS) + SALT)
    content = mix(sums.sum(axis=1, dtype=U64)[:, None] - sums) + name[:, None] + np.arange(PARTS, dtype=U64)
    some = (kinds[:, None] - full) > 0
    return mix(content[some]), np.broadcast_to(of[:, None], some.shape)[some], spread <= limits


def signed_sets(sets: Sets, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of ``sets``, and the index of the set of each."""
    ends = np.array(band_ends(int(sets.sizes.max(initial=1))))
    own = np.searchsorted(ends, sets.sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rare = sets.without(common)
    for group in (own - 1, own):
        limits = np.where(group >= 0, ends[np.maximum(group, 0)] // 4, 0)
        last = []
        mine = np.nonzero((limits > 0) & (sets.sizes > 0))[0]
        for level in (rare, sets):
            sigs, of, missing = subsets(level.take(mine), group[mine], limits[mine])
            found.append((sigs, mine[of]))
            mine = mine[missing]
            whole = level.sizes[mine] == sets.sizes[mine]
            last.append(mine[whole])
            mine = mine[~whole]
        mine = np.sort(np.concatenate(last))
        single = sets.take(mine)
        found.append((mix(single.elements ^ mix(salted(group[mine] + 1))[single.owners]), mine[single.owners]))
    return np.concatenate([s for s, _ in found]), np.concatenate([o for _, o in found])


def signatures(elements: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """The signatures of one set, sorted and distinct. Sets of fewer than four elements link with equal ones only, and
    have their fingerprint instead."""
    sets = Sets(np.sort(elements), np.array([len(elements)]))
    found = signed_sets(sets, np.empty(0, U64) if common is None else np.sort(common))[0]
    return np.unique(found) if len(found) else sets.fingerprints().view(U64)


def frequent(held: tuple[np.ndarray, np.ndarray] | None, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries counters of elements, with those of one more slice."""
    values, counts = np.unique(elements, return_counts=True)
    if held is not None:
        values, back = np.unique(np.concatenate((held[0], values)), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate((held[1], counts)), minlength=len(values)).astype(np.int64)
    if len(values) > COMMON:
        counts = counts - np.partition(counts, len(counts) - COMMON - 1)[len(counts) - COMMON - 1]
        values, counts = values[counts > 0], counts[counts > 0]
    return values, counts


def sized(docs: DataFrame) -> DataFrame:
    """key, check, doc_id, n_shingles, fp (null: the empty set) and sketch of each document; and rows of ``element``
    and ``shared``, the elements that many documents of a task have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in slices(batch):
                sets = Sets.of_texts(part.column("text"))
                some = sets.sizes > 0
                held = frequent(held, sets.elements)
                parities, words = sets.sketches()
                parities, words = parities[np.repeat(some, words)], np.where(some, words, 0)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"), part.column("check"), part.column("doc_id"), pa.array(sets.sizes), pa.array(sets.fingerprints(), mask=~some),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(words))), pa.int32()), pa.array(parities)), none, none,
                    ],
                    names,
                )
        if held is not None and len(held[0]):
            none = pa.nulls(len(held[0]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, none, pa.nulls(len(held[0]), pa.list_(pa.int64())), pa.array(held[0].view(np.int64)), pa.array(held[1])], names
            )

    names = ["key", "check", "doc_id", "n_shingles", "fp", "sketch", "element", "shared"]
    schema = "key long, check long, doc_id long, n_shingles long, fp long, sketch array<long>, element long, shared long"
    keyed = docs.withColumns(row_keys())
    return keyed.select("key", "check", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def signed(docs: DataFrame, hot: list[tuple[int, int]], common: list[int]) -> DataFrame:
    """sig, fp: the signatures of each class. ``hot`` (fp, key) are classes of many copies, which only their text of
    that key signs; ``common`` are elements to leave out."""
    spark = docs.sparkSession
    lists = spark.sparkContext.broadcast((np.array(sorted(hot), np.int64).reshape(-1, 2), np.sort(np.array(common, np.int64).view(U64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, common = lists.value
        for batch in batches:
            for part in slices(batch):
                sets = Sets.of_texts(part.column("text"))
                fps, key = sets.fingerprints(), part.column("key").to_numpy()
                at = np.minimum(np.searchsorted(hot[:, 0], fps), max(0, len(hot) - 1))
                mine = (hot[at, 0] != fps) | (hot[at, 1] == key) if len(hot) else np.ones(len(fps), bool)
                chosen = np.sort(np.unique(np.where(mine & (sets.sizes > 0), fps, -1), return_index=True)[1])
                chosen = chosen[mine[chosen] & (sets.sizes[chosen] > 0)]
                sigs, of = signed_sets(sets.take(chosen), common)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(fps[chosen][of])], ["sig", "fp"])

    return docs.select(row_keys()["key"].alias("key"), "text").mapInArrow(run, "sig long, fp long")


def runs(key: np.ndarray) -> np.ndarray:
    """The starts of runs of equal keys."""
    return np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.empty(0, np.int64)


def gathered(batches: Iterator[pa.RecordBatch], columns: list[str], least: int) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """The rows of many batches as arrays of ``least`` rows or more, and whether they are the last."""
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        rows = {}
        for c in columns:
            col = batch.column(c)
            rows[c] = col.to_numpy(zero_copy_only=False)
        if batch.num_rows:
            held.append(rows)
            size += batch.num_rows
        if size >= least:
            yield {c: np.concatenate([h[c] for h in held]) for c in columns}, False
            held, size = [], 0
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in columns}, True
    else:
        yield {}, True


def buckets(batches: Iterator[pa.RecordBatch], columns: list[str], least: int = HELD) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Rows sorted by their first column, as arrays, with the starts of its runs; a run is never divided."""
    left: dict[str, np.ndarray] = {}
    for rows, last in gathered(batches, columns, least):
        if left:
            rows = {c: np.concatenate((left[c], rows[c])) for c in columns} if rows else left
        if not rows:
            return
        starts = runs(rows[columns[0]])
        if not last:
            left = {c: v[starts[-1] :] for c, v in rows.items()}
            rows, starts = {c: v[: starts[-1]] for c, v in rows.items()}, starts[:-1]
        if len(starts):
            yield rows, starts


def candidates(sigs: DataFrame) -> DataFrame:
    """bucket, a, b: pairs of classes (bucket null), and the classes of larger buckets (b null). A run of one signature
    passes through in pieces of about HELD rows, with its first class and the last one seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        left: tuple[np.ndarray, np.ndarray] | None = None
        going = None  # the signature of a run of which a piece has passed
        for rows, last in gathered(batches, ["sig", "fp"], HELD):
            sig, fp = (rows["sig"], rows["fp"]) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))
            if left is not None:
                sig, fp = np.concatenate((left[0], sig)), np.concatenate((left[1], fp))
            if not len(sig):
                return
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])))
            sig, fp = sig[new], fp[new]
            starts = runs(sig)
            gone = going is not None and sig[0] == going
            long = not last and len(sig) - starts[-1] > HELD  # all rows of the last run so far are looked at, two are kept
            if not last:
                left = (sig[starts[-1] :], fp[starts[-1] :])
                if long:
                    left = (left[0][[0, -1]], left[1][[0, -1]])
                    going = sig[-1]
                else:
                    sig, fp, starts = sig[: starts[-1]], fp[: starts[-1]], starts[:-1]
            if not len(sig):
                continue
            sizes = np.diff(np.append(starts, len(sig)))
            lead, later = np.repeat(fp[starts], sizes), np.arange(len(sig)) - np.repeat(starts, sizes)
            follow = np.nonzero(later > 0)[0]
            a = np.concatenate((lead[follow], fp[follow - 1]))
            b = np.concatenate((fp[follow], fp[follow]))
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0)
            fresh &= a != b
            a, b = a[fresh], b[fresh]
            large = sizes > 3
            large[0] |= gone
            large = np.nonzero(large)[0]
            contents = np.add.reduceat(mix(fp.view(U64)), starts)[large].tolist()
            keep = []
            for i, content in zip(large.tolist(), contents, strict=True):
                if content not in seen or (long and i == len(sizes) - 1):
                    seen.add(content)
                    keep.append(i)
            if len(seen) > 100_000:
                seen.clear()
            chosen = np.zeros(len(sizes), bool)
            chosen[keep] = True
            at = np.nonzero(np.repeat(chosen, sizes))[0]
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b)], ["bucket", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(fp[at]), pa.nulls(len(at), pa.int64())], ["bucket", "a", "b"])

    dealt = sigs.repartition("sig").sortWithinPartitions("sig", "fp")
    return dealt.mapInArrow(run, "bucket long, a long, b long")


def may_link(na: Column, nb: Column, sa: Column, sb: Column) -> Column:
    def folded(s: Column, other: Column) -> Column:
        half = (F.size(s) / 2).cast("int")
        halves = (F.slice(s, F.lit(1), half), F.slice(s, half + 1, half))
        return F.when(F.size(s) > F.size(other), F.zip_with(*halves, lambda x, y: x.bitwiseXOR(y))).otherwise(s)

    sa, sb = folded(sa, sb), folded(sb, sa)  # sizes of sets that may link differ by a quarter, so one fold is enough
    different = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (100 * F.least(na, nb) >= LEVEL * F.greatest(na, nb)) & (9 * different <= na + nb)


def sieve(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches don't rule out."""
    one = lambda e: classes.select(F.col("fp").alias(e), F.col("n").alias(f"n_{e}"), F.col("sketch").alias(f"s_{e}"))
    rows = pairs.join(one("a"), "a").join(one("b"), "b")
    return rows.where(may_link(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"))).select("a", "b")


def texts_of(need: DataFrame, docs: DataFrame) -> DataFrame:
    """fp, text of the classes ``need`` (fp, key). Rows whose key is another's by chance give texts of other classes,
    and repeated rows give a text again; fingerprints tell."""
    bit = lambda c: F.pmod(c, F.lit(NEEDED_BITS))
    word = need.select(bit(F.col("key")).alias("bit")).groupBy(F.expr("bit div 64").alias("word"))
    bitmap = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    mine = docs.select(row_keys()["key"].alias("key"), "text").withColumn("bit", bit(F.col("key")))
    near = mine.join(F.broadcast(bitmap), F.expr("bit div 64") == bitmap.word)
    near = near.where(F.expr("shiftright(bits, cast(bit % 64 as int)) & 1L") == 1).select("key", "text")
    return near.join(need, "key").select("fp", "text")


def same_length(sketches: Sequence[np.ndarray]) -> np.ndarray:
    """Sketches, folded to the length of the shortest, as rows."""
    least = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(s.reshape(-1, least), axis=0) for s in sketches])


def across(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of the same bucket but of different components, that the sketches don't rule out."""
    roots = labels.select(F.col("node").alias("fp"), "root")
    rows = members.select("bucket", F.col("a").alias("fp")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    split = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high")
    rows = rows.join(split.select("bucket", "size"), "bucket").join(classes.select("fp", "n", "sketch"), "fp")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("pair", F.struct("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")))
    rows = rows.select(F.xxhash64("pair").alias("block"), "fp", "root", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in buckets(batches, ["block", "fp", "root", "n", "sketch"], HELD // 16):
            ends = np.append(starts[1:], len(rows["fp"]))
            found = []
            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                fp, root, n = (rows[c][start:end] for c in ("fp", "root", "n"))
                bits = same_length(rows["sketch"][start:end])
                roots, back, sizes = np.unique(root, return_inverse=True, return_counts=True)
                # Of each pair one at least isn't in the most frequent component.
                loose = np.nonzero(back != sizes.argmax())[0]
                later = np.ones(len(fp), bool)
                for i in loose.tolist():
                    later[i] = False
                    far = np.nonzero(later & (root != root[i]))[0]
                    far = far[100 * np.minimum(n[far], n[i]) >= LEVEL * np.maximum(n[far], n[i])]
                    if len(far):
                        # Of signed numbers numpy counts the bits of the absolute value.
                        different = np.bitwise_count((bits[far] ^ bits[i]).view(U64)).sum(axis=1, dtype=np.int64)
                        far = far[9 * different <= n[far] + n[i]]
                        found += [(min(fp[i], fp[j]), max(fp[i], fp[j])) for j in far]
            pairs = list(dict.fromkeys((int(a), int(b)) for a, b in found))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition("block").sortWithinPartitions("block", "fp")
    return dealt.mapInArrow(run, "a long, b long").where("a < b").distinct()


class Block:
    """Sets that are compared with each other: all with all, or (``first`` > 0) the first so many with the others."""

    def __init__(self, sets: Sets, first: int = 0) -> None:
        self.n, self.first = sets.sizes.astype(np.int64), first
        distinct, self.codes = np.unique(sets.elements, return_inverse=True)
        self.starts = sets.starts
        self.mark = np.zeros(len(distinct), np.int32)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the ascending ``others`` set i links with."""
        sized = (100 * np.minimum(self.n[others], self.n[i]) >= LEVEL * np.maximum(self.n[others], self.n[i]))
        others = others[sized]
        if not len(others):
            return others
        n = self.n[others]
        ends = np.cumsum(n)
        own = self.codes[self.starts[i] : self.starts[i] + self.n[i]]
        self.mark[own] = 1
        if len(others) == others[-1] - others[0] + 1:
            theirs = self.codes[self.starts[others[0]] : self.starts[others[-1]] + self.n[others[-1]]]
        else:
            theirs = self.codes[np.arange(ends[-1]) + np.repeat(self.starts[others] - (ends - n), n)]
        both = np.add.reduceat(self.mark[theirs], ends - n)
        self.mark[own] = 0
        return others[100 * both.astype(np.int64) >= LEVEL * (self.n[i] + n - both)]

    def count(self, copies: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """For each set the sum of ``copies`` of those it links with, and links that hold all together."""
        size = len(self.n)
        links, home, tree = np.zeros(size, np.int64), np.arange(size), []
        for i in range(self.first or size):
            near = self.near(i, np.arange(max(self.first, i + 1), size))
            if not len(near):
                continue
            links[i] += copies[near].sum()
            links[near] += copies[i]
            homes, at = np.unique(home[near], return_index=True)
            new = homes != home[i]
            if new.any():
                tree += [(i, int(j)) for j in near[at[new]]]
                home[np.isin(home, homes[new])] = home[i]
        return links, tree

    def search(self) -> list[tuple[int, int]]:
        """Links that hold all together, breadth first: no pair of sets that are already together is compared."""
        tree: list[tuple[int, int]] = []
        left = [np.arange(self.first, len(self.n))] + ([np.arange(self.first)] if self.first else [])
        while len(left[0]) and len(left[-1]):
            waiting = [int(left[-1][0])]
            left[-1] = left[-1][1:]
            while waiting:
                i = waiting.pop()
                other = -1 if i >= self.first else 0
                near = self.near(i, left[other])
                if len(near):
                    left[other] = np.setdiff1d(left[other], near, assume_unique=True)
                    tree += [(i, j) for j in near.tolist()]
                    waiting += near.tolist()
        return tree


def exact(docs: DataFrame, classes: DataFrame, labels: DataFrame, count: bool) -> DataFrame:
    """a, b, links: links (a, b) between the ``classes`` (fp, n, key, copies) of each component of ``labels`` that hold
    all that link together; and, if they are to be counted, for each class a (b null) the number of documents that it
    links with in one block."""
    rows = classes.select("fp", "n", "key", "copies").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    homes = rows.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("elements")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    rows = materialise(rows.join(homes.withColumn("blocks", blocks), "root"), "families")
    packs = max(1, math.ceil((rows.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) / BLOCK_ELEMENTS))

    texts = texts_of(rows.select("fp", "key"), docs)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int")).join(texts, "fp")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Components of one block go to tasks many at a time.
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(packs)))
    rows = rows.select(
        F.when(pack.isNull(), F.col("root")).alias("large"), pack.alias("pack"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "root", "block", "fp", "copies", "text",
    )

    def compare(table: pa.Table) -> pa.Table:
        first = table.column("x")[0].as_py()
        cross = first != table.column("y")[0].as_py()
        facts, held = [], []
        for batch in table.to_batches():
            for part in slices(batch):
                sets = Sets.of_texts(part.column("text"))
                held.append(sets)
                real = (sets.sizes > 0) & (sets.fingerprints() == part.column("fp").to_numpy())
                facts.append(np.stack([*(part.column(c).to_numpy() for c in ("root", "block", "fp", "copies")), real], axis=1).astype(np.int64))
        sets, facts = Sets(np.concatenate([s.elements for s in held]), np.concatenate([s.sizes for s in held])), np.concatenate(facts)
        root, block, fp, copies, real = facts.T
        # Families one after the other, a block's first; each class once.
        order = np.lexsort((fp, block != first, root))
        order = order[real[order] > 0]
        order = order[np.concatenate(([True], np.diff(fp[order]) != 0))] if len(order) else order
        out: list[tuple[np.ndarray, ...]] = []
        for mine in np.split(order, runs(root[order])[1:]):
            ahead = int((block[mine] == first).sum())
            if len(mine) < 2 or (cross and ahead in (0, len(mine))):
                continue
            some = Block(Sets(np.concatenate([sets[i] for i in mine]), sets.sizes[mine]), ahead if cross else 0)
            name = fp[mine]
            links, tree = some.count(copies[mine]) if count else (np.empty(0, np.int64), some.search())
            ends = np.array(tree, np.int64).reshape(-1, 2)
            linked = np.nonzero(links)[0]
            out.append((name[ends].min(axis=1), name[ends].max(axis=1), np.zeros(len(ends), np.int64)))
            out.append((name[linked], np.full(len(linked), -1), links[linked]))
        a, b, links = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))
        return pa.table({"a": pa.array(a), "b": pa.array(b, mask=b < 0), "links": pa.array(links)})

    return rows.groupBy("large", "pack", "x", "y").applyInArrow(compare, "a long, b long, links long")


def link(docs: DataFrame, count: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The membership of documents in classes of equal sets (key, check, doc_id, n_shingles, fp), the classes (fp, n,
    rep, copies), and what ``exact`` says of them."""
    small_batches(docs.sparkSession)
    both = materialise(sized(docs), "sets")
    facts = both.where("element IS NULL").select("key", "check", "doc_id", "n_shingles", "fp", "sketch")
    classes = facts.where("fp IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch")
    )
    classes = materialise(classes, "classes")
    hot = classes.where(F.col("copies") >= HOT_COPIES).orderBy(F.desc("copies"), "fp").limit(HOT_CLASSES).select("fp", "key").collect()
    shared = both.where("element IS NOT NULL").groupBy("element").agg(F.sum("shared").alias("shared"))
    least = max(HOT_COPIES, facts.count() // COMMON_SHARE)
    common = shared.where(F.col("shared") >= least).orderBy(F.desc("shared"), "element").limit(COMMON).collect()
    found = materialise(candidates(signed(docs, [tuple(r) for r in hot], [r.element for r in common])), "candidates")
    pairs = materialise(sieve(found.where("b IS NOT NULL").select("a", "b").distinct(), classes), "pairs")
    labels = components(pairs)
    rest = materialise(across(found.where("b IS NULL"), labels, classes), "rest")
    if rest.limit(1).count():
        labels = components(pairs.unionByName(rest))
    return facts.drop("sketch"), classes.drop("sketch"), materialise(exact(docs, classes, labels, count), "links")


def named(facts: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``facts`` with component_id, and the ``root`` of the component (null: the empty set)."""
    labels = components(links.where("b IS NOT NULL").select("a", "b").distinct())
    rooted = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    return facts.join(names, "fp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    return named(*link(docs, count=False)).select("doc_id", "n_shingles", "component_id")


def near_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of ``docs`` (doc_id, text); n_links is the number of other
    rows whose sets it links with, equal sets among them."""
    facts, classes, links = link(docs, count=True)
    found = links.where("b IS NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    own = classes.join(found, "fp", "left").select("fp", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = named(facts, classes, links).join(own, "fp", "left")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each component the one of smallest doc_id (null last), and
    every different row without words. Rows that repeat doc_id and text count as one, the first by a hash of all
    columns. Texts are shuffled once."""
    rows = named(*link(docs.select("doc_id", "text"), count=False))
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "check")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(best).alias("row")).select("row.key", "row.check")
    stay = first.unionByName(rows.where("root IS NULL").select("key", "check").distinct()).toDF("_rm_key", "_rm_check")
    mine = docs.withColumns({f"_rm_{name}": key for name, key in row_keys().items()})
    nth = F.row_number().over(W.partitionBy("_rm_key", "_rm_check").orderBy(content_hash(docs)))
    return mine.join(stay, ["_rm_key", "_rm_check"]).withColumn("_rm_nth", nth).where("_rm_nth = 1").select(docs.columns)

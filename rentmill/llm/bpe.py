"""Byte-level BPE encoding by speculation and verification, and decoding.

A text is cut into units: a run of white space and the run of other characters after it. The vocabulary's pattern,
and special tokens, cut no differently inside a unit than inside the text, so each distinct unit is encoded once and
its tokens are gathered wherever it occurs. (Only texts with white space beyond ASCII are one unit.) Units are cut
at special tokens, then into words by the pattern. For each new word

1. greedy longest match proposes tokens;
2. vectorised checks test every adjacent pair of tokens: a pair stands if merging both tokens' bytes from scratch
   would never join across the boundary;
3. only words with a failing pair are merged exactly, lowest rank first.

If every adjacent pair stands, no merge of the whole word ever crosses a proposed boundary, so the proposal is the
encoding. A pair fails exactly if a token a on the right edge inside the left token and a token b on the left edge
inside the right one have a merge whose rank comes before a's own merge into its parent (on a tie the left merge is
first), and not after b's. Tokens that exact merging of their own bytes doesn't give are never proposed.

The job is narrow: no shuffle, one broadcast of the vocabulary file (a file of fixed size). A task holds one slice of
4 MB of text or one document, and a cache of at most ``CACHE_UNITS`` short units and ``CACHE_TOKENS`` tokens; longer
units, which rarely come again, are encoded for their slice only.

Null texts count as empty and give no tokens. Repeated rows are encoded alike. Extra columns stay.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .words import SPACE, slices, text_bytes

#: The pattern that byte-level vocabularies of this kind split words by.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NEVER = np.int32(2**31 - 1)
#: White space that the pattern knows and ASCII doesn't.
WIDE_SPACE = r"[\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Units longer than LONG bytes are not kept; words longer than LONG are merged with a heap, the others in bulk.
CACHE_UNITS, LONG, SLICE_BYTES = 500_000, 48, 4 << 20
CACHE_TOKENS = 4_000_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: a visible Latin-1 byte is itself,
    the others are counted up from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, content: bytes) -> None:
        file = json.loads(content)
        letters = byte_letters()
        ids = file["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        n = max([*ids.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for text, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        for text, i in special.items():
            self.bytes[i] = text.encode()
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.merges = {(int(a), int(b)): (rank, int(c)) for rank, (a, b, c) in enumerate(zip(left, right, made, strict=True))}
        keys = left * n + right
        order = np.argsort(keys)
        self._n, self._keys, self._ranks, self._made = n, keys[order], order.astype(np.int32), made
        parts = {int(c): (int(a), int(b), rank) for rank, (a, b, c) in reversed(list(enumerate(zip(left, right, made, strict=True))))}
        self.left_edge, self.left_joined = self._edge(parts, 0)
        self.right_edge, self.right_joined = self._edge(parts, 1)
        self.single = {self.bytes[i][0]: i for i in ids.values() if len(self.bytes[i]) == 1}
        # A token is proposed if merging its own bytes gives it: its two parts are proposed and stand until its own merge.
        sure = np.zeros(n, bool)
        sure[list(self.single.values())] = True
        a, b, r = (np.array([v[k] for v in parts.values()], np.int64) for k in range(3))
        c = np.array(list(parts), np.int64)
        stands = self.stand(a, b, r)
        for i in np.argsort(r):
            sure[c[i]] = stands[i] and sure[a[i]] and sure[b[i]]
        self.lookup = {self.bytes[i]: i for i in ids.values() if sure[i]}
        sizes: dict[bytes, set[int]] = {}
        for word in self.lookup:
            if len(word) > 2:
                sizes.setdefault(word[:3], set()).add(len(word))
        self.tries = {start: (*sorted(found, reverse=True), 2, 1) for start, found in sizes.items()}
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int]] = []
        for word in self.lookup:
            for k in range(len(word)):
                if word[: k + 1] not in nodes:
                    edges.append((nodes[word[:k]] * 256 + word[k], len(nodes)))
                    nodes[word[: k + 1]] = len(nodes)
        edges.sort()
        self._edges, self._below = np.array(edges, np.int64).T.copy()
        self._ends = np.array([self.lookup.get(w, -1) for w in nodes], np.int64)
        self.token_size = np.array([len(b) for b in self.bytes], np.int64)
        self.token_start = np.concatenate(([0], np.cumsum(self.token_size)))[:-1]
        self.token_data = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _edge(self, parts: dict[int, tuple[int, int, int]], side: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token the tokens along one edge inside it, itself first (-1: none), and the ranks at which they
        are joined into the one before (the token itself: never)."""
        chains = []
        for t in range(self._n):
            chain, rank = [], NEVER
            while True:
                chain.append((t, rank))
                if t not in parts:
                    break
                t, rank = parts[t][side], parts[t][2]
            chains.append(chain)
        deep = max(map(len, chains))
        edge, joined = np.full((self._n, deep), -1, np.int64), np.zeros((self._n, deep), np.int32)
        for t, chain in enumerate(chains):
            edge[t, : len(chain)] = [x for x, _ in chain]
            joined[t, : len(chain)] = [x for _, x in chain]
        return edge, joined

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the merges of pairs of tokens."""
        keys = left * self._n + right
        found = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[found] == keys, self._ranks[found], NEVER)

    def stand(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: no merge crosses their boundary (of those that rank under ``before``)."""
        good = np.ones(len(left), bool)
        for i in range(self.right_edge.shape[1]):
            a = self.right_edge[left, i]
            at_i = np.nonzero(a >= 0)[0]
            if not len(at_i):
                break
            for j in range(self.left_edge.shape[1]):
                b = self.left_edge[right[at_i], j]
                at = at_i[b >= 0]
                if not len(at):
                    break
                rank = self.rank(a[at], b[b >= 0])
                crosses = (rank < self.right_joined[left[at], i]) & (rank <= self.left_joined[right[at], j]) & (rank < NEVER)
                if before is not None:
                    crosses &= rank < before[at]
                good[at[crosses]] = False
        return good

    def propose(self, word: bytes) -> list[int]:
        whole = self.lookup.get(word)
        if whole is not None:
            return [whole]
        out, at, end = [], 0, len(word)
        lookup, tries = self.lookup, self.tries
        while at < end:
            for size in tries.get(word[at : at + 3], (2, 1)):
                token = lookup.get(word[at : at + size])
                if token is not None and at + size <= end:
                    out.append(token)
                    at += size
                    break
        return out

    def propose_all(self, words: list[bytes]) -> list[list[int]]:
        """Greedy longest match of many words, which walk the trie of tokens side by side."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > LONG:
            last = order.pop()
            out[last] = self.propose(words[last])
        for k in range(0, len(order), 20_000):
            self._walk([words[i] for i in order[k : k + 20_000]], order[k : k + 20_000], out)
        return out

    def _walk(self, words: list[bytes], places: list[int], out: list[list[int]]) -> None:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        data = np.zeros((len(words), width + 1), np.int64)
        data[:, :width][np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        found = np.full((len(words), width), -1, np.int64)
        rows, n = np.arange(len(words))[sizes > 0], np.zeros(len(words), np.int64)
        at, node, token, end = (np.zeros(len(words), np.int64) for _ in range(4))
        while len(rows):
            keys = node[rows] * 256 + data[rows, at[rows]]
            edge = np.minimum(np.searchsorted(self._edges, keys), len(self._edges) - 1)
            on = (self._edges[edge] == keys) & (at[rows] < sizes[rows])
            step, stop = rows[on], rows[~on]
            below = self._below[edge[on]]
            node[step] = below
            at[step] += 1
            done = self._ends[below]
            token[step[done >= 0]], end[step[done >= 0]] = done[done >= 0], at[step[done >= 0]]
            found[stop, n[stop]] = token[stop]
            n[stop] += 1
            at[stop], node[stop] = end[stop], 0
            rows = np.concatenate((step, stop[end[stop] < sizes[stop]]))
        for place, line, k in zip(places, found.tolist(), n.tolist(), strict=True):
            out[place] = line[:k]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words: each round makes the first of the lowest-ranked merges in every word."""
        out: list[list[int]] = [[] for _ in words]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > LONG:
            last = order.pop()
            out[last] = self.merge(words[last])
        for k in range(0, len(order), 20_000):
            self._merge_block([words[i] for i in order[k : k + 20_000]], order[k : k + 20_000], out)
        return out

    def _merge_block(self, words: list[bytes], places: list[int], out: list[list[int]]) -> None:
        width, n = max(map(len, words)), len(words)
        sizes = np.array([len(w) for w in words])
        one = np.zeros(256, np.int64)
        one[list(self.single)] = list(self.single.values())
        tokens = np.full((n, width + 1), -1, np.int64)
        tokens[np.arange(width + 1) < sizes[:, None]] = one[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, width), NEVER, np.int32)
        both = tokens[:, 1:] >= 0
        ranks[both] = self.rank(tokens[:, :-1][both], tokens[:, 1:][both])
        rows, columns = np.arange(n), np.arange(width + 1)
        done = np.full((n, width + 1), -1, np.int64)
        while len(rows):
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), best]
            more = rank < NEVER
            done[rows[~more]] = tokens[~more]
            rows, tokens, ranks, best, rank = rows[more], tokens[more], ranks[more], best[more], rank[more]
            if not len(rows):
                break
            here = np.arange(len(rows))
            tokens[here, best] = self._made[rank]
            shift = np.minimum(columns + (columns > best[:, None]), width)
            tokens, ranks = np.take_along_axis(tokens, shift, 1), np.take_along_axis(ranks, np.minimum(shift[:, :-1], width - 1), 1)
            tokens[:, -1] = -1
            ranks[:, -1] = NEVER
            for at in (best - 1, best):
                real = (at >= 0) & (at < width)
                real[real] = tokens[here[real], at[real] + 1] >= 0
                ranks[here[real], at[real]] = self.rank(tokens[here[real], at[real]], tokens[here[real], at[real] + 1])
                gone = (at >= 0) & ~real & (at < width)
                ranks[here[gone], at[gone]] = NEVER
        for place, line in zip(places, done.tolist(), strict=True):
            out[place] = [t for t in line if t >= 0]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals; a heap over a linked list of tokens."""
        tokens = [self.single[b] for b in word]
        after, behind = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := self.merges.get((tokens[i], tokens[j]))):
                heapq.heappush(heap, (m[0], i, tokens[i], tokens[j]))

        for i in range(len(tokens) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or tokens[i] != a or tokens[j] != b:
                continue
            tokens[i], tokens[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                behind[after[i]] = i
            offer(i)
            if behind[i] >= 0:
                offer(behind[i])
        return [t for t in tokens if t >= 0]


class Encoder:
    """A vocabulary with the units encoded so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def made(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of ``units``, and each one's number of tokens."""
        v = self.vocabulary
        words: dict[str | tuple[str, str], int] = {}
        codes: list[int] = []
        owners = np.zeros(len(units), np.int64)
        for k, unit in enumerate(units):
            before = len(codes)
            if unit[0] == " " and unit[1:].isalpha():
                codes.append(words.setdefault(unit, len(words)))
                owners[k] = 1
                continue
            for j, part in enumerate(v.cut.split(unit) if v.cut and v.cut.search(unit) else (unit,)):
                for word in (("", part),) if j % 2 else WORDS.findall(part):
                    code = words.setdefault(word, len(words))
                    codes.append(code)
            owners[k] = len(codes) - before
        made = v.propose_all([b"" if isinstance(word, tuple) else word.encode() for word in words])
        for word, code in words.items():
            if isinstance(word, tuple):
                made[code] = [v.special[word[1]]]
        self._verify(list(words), made)
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter((t for tokens in made for t in tokens), np.uint32, int(sizes.sum()))
        chosen = np.array(codes, np.int64)
        edges = np.concatenate(([0], np.cumsum(owners)))
        new = gather(flat, np.cumsum(sizes) - sizes, sizes, chosen)
        ends = np.concatenate(([0], np.cumsum(sizes[chosen])))[edges]
        return new, np.diff(ends)

    def _verify(self, words: list[str], made: list[list[int]]) -> None:
        """Merge exactly the words of which a pair of proposed tokens fails."""
        v = self.vocabulary
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter((t for tokens in made for t in tokens), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(made)), sizes)
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        pairs, back = np.unique(flat[inner] * len(v.bytes) + flat[inner + 1], return_inverse=True)
        fails = ~v.stand(pairs // len(v.bytes), pairs % len(v.bytes))[back]
        wrong = np.unique(owner[inner[fails]]).tolist()
        for i, tokens in zip(wrong, v.merge_all([words[i].encode() for i in wrong]), strict=True):
            made[i] = tokens

    def encode(self, col: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, and each text's number of tokens. ``col`` has no nulls."""
        units, per_text = cut_units(col)
        coded = units.dictionary_encode()
        found = coded.dictionary.to_pylist()
        new = [u for u in found if u not in self.known]
        tokens, sizes = self.made(new) if new else (np.empty(0, np.uint32), np.empty(0, np.int64))
        # Known units and those of this slice, one after the other.
        at = dict(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        places = np.fromiter((self.known[u] if u in self.known else at[u] for u in found), np.int64, len(found))
        flat = np.concatenate((self.tokens, tokens))
        starts = np.concatenate((self.starts, len(self.tokens) + np.cumsum(sizes) - sizes))
        lengths = np.concatenate((self.sizes, sizes))
        codes = places[coded.indices.to_numpy()] if len(found) else np.empty(0, np.int64)
        ids = gather(flat, starts, lengths, codes)
        totals = np.concatenate(([0], np.cumsum(lengths[codes])))
        edges = np.concatenate(([0], np.cumsum(per_text)))
        self._keep(new, tokens, sizes)
        return ids, totals[edges[1:]] - totals[edges[:-1]]

    def _keep(self, units: list[str], tokens: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the short ones of the slice's new units."""
        short = np.fromiter((len(u) <= LONG for u in units), bool, len(units))
        if not short.any():
            return
        if len(self.known) > CACHE_UNITS or len(self.tokens) > CACHE_TOKENS:
            self.clear()
        first, n = len(self.tokens), len(self.sizes)
        self.known.update(zip((u for u, s in zip(units, short, strict=True) if s), range(n, n + int(short.sum())), strict=True))
        self.tokens = np.concatenate((self.tokens, tokens[np.repeat(short, sizes)]))
        self.sizes = np.concatenate((self.sizes, sizes[short]))
        self.starts = np.concatenate((self.starts, first + np.cumsum(sizes[short]) - sizes[short]))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen pieces of ``flat``, one after the other."""
    size = sizes[chosen]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[chosen] - (ends - size), size)]


def cut_units(col: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All units of all texts, and each text's number of units."""
    data, offsets = text_bytes(col)
    space = SPACE[data]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:-1] = ~space[:-1] & space[1:]
    wide = pc.match_substring_regex(col, WIDE_SPACE).to_numpy(zero_copy_only=False)
    for i in np.nonzero(wide)[0]:
        ends[offsets[i] : offsets[i + 1]] = False
    ends[offsets] = True
    ends[0] = False
    at = np.nonzero(ends)[0]
    before = np.concatenate(([0], np.cumsum(ends)))
    per_text = before[offsets[1:] + 1] - before[offsets[:-1] + 1]
    bounds = np.concatenate(([0], at)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))), per_text


def token_bytes(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    return gather(vocabulary.token_data, vocabulary.token_start, vocabulary.token_size, ids)


_encoders: dict[int, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(content))
    return _encoders[key]


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` long and ``ids`` binary (little-endian unsigned 32-bit integers), which replace
    columns of those names; with ``decoded``, also the text that the ids decode to, under that name."""
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_bytes())
    added = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    added += [StructField(decoded, StringType())] if decoded else []
    docs = docs.drop(*(f.name for f in added))
    schema = StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                ids, counts = encoder.encode(pc.fill_null(part.column(text), ""))
                new = [pa.array(counts, pa.int64()), _binary(ids.astype("<u4").tobytes(), counts * 4)]
                if decoded:
                    new.append(_text(encoder.vocabulary, ids, counts))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _text(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Decoded texts; bytes that aren't UTF-8 become U+FFFD."""
    data = token_bytes(vocabulary, ids).tobytes()
    ends = np.concatenate(([0], np.cumsum(vocabulary.token_size[ids])))[np.concatenate(([0], np.cumsum(counts)))]
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids``; null ids give an empty text."""
    content = encoded.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_bytes())
    encoded = encoded.drop(text)
    schema = StructType([*encoded.schema.fields, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(content.value).vocabulary
        for batch in batches:
            for part in slices(batch, ids, SLICE_BYTES):
                raw = [x or b"" for x in part.column(ids).to_pylist()]
                tokens = np.frombuffer(b"".join(raw), "<u4")
                new = _text(vocabulary, tokens, np.array([len(x) // 4 for x in raw], np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, new], schema.fieldNames())

    return encoded.mapInArrow(run, schema)

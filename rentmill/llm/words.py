"""Words, windows and rolling hashes of Arrow text columns, vectorised in numpy.

A word is a longest run without ASCII white space, ``[^\\x20\\x09-\\x0D]+``. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
MULT = 0x9E3779B97F4A7C15 | 1
INV = pow(MULT, -1, 1 << 64)
#: Bytes of text that are worked on at a time; a longer document makes a slice of its own.
SLICE_BYTES = 2 << 20
#: Powers that are kept for the next slice, 16 MB a base.
KEPT_POWERS = 1 << 21


def flags(values: Iterable[int]) -> np.ndarray:
    """Which of the 256 bytes are among ``values``."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


SPACE = flags([0x20, *range(0x09, 0x0E)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(col: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the len(col) + 1 byte offsets of the texts. ``col`` has no nulls."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``limit`` bytes of text, or of one document."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
        pa.default_memory_pool().release_unused()


def sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each of the segments [starts[i], starts[i + 1])."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


#: A random number for each byte; their sums, weighted by powers of MULT along a word, are its hash before mixing.
BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], U64)


def word_hashes(vocabulary: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each of the words, none of which is empty."""
    if not len(vocabulary):
        return np.empty(0, U64)
    data, offsets = text_bytes(vocabulary)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    weights = powers(MULT, int(np.diff(offsets).max()))
    return mix(np.add.reduceat(BYTES[data] * weights[place], offsets[:-1]))


class Words:
    """Words of a column of texts: ``codes`` into ``vocabulary`` and ``starts``, each document's first word."""

    def __init__(self, col: pa.Array, lower: bool = False) -> None:
        col = pc.fill_null(col, "")
        if lower:
            col = pc.ascii_lower(col)
        lists = pc.ascii_split_whitespace(col)
        flat = lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.starts = before[offsets - offsets[0]]
        coded = flat.filter(real).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = coded.dictionary

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @cached_property
    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return word_hashes(self.vocabulary)[self.codes]

    @cached_property
    def _rolling(self) -> np.ndarray:
        return np.concatenate((np.zeros(1, U64), np.cumsum(self.hashes * powers(INV, len(self)), dtype=U64)))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of all ``n``-word windows inside one document, and their rolling hashes."""
        if len(self) < n:
            return np.empty(0, np.int64), np.empty(0, U64)
        ends = self.starts[1:][self.documents]
        at = np.nonzero(np.arange(len(self)) + n <= ends)[0]
        return at, self.spans(at, n)

    def spans(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Rolling hashes of the ``n`` words from each of the positions ``at``."""
        return mix((self._rolling[at + n] - self._rolling[at]) * powers(MULT, len(self))[at])


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of ``n`` that begins at one of ``starts``."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(np.minimum(starts + n, size), minlength=size + 1)
    return np.cumsum(edge[:size]) > 0

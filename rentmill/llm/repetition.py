"""Quality rules from repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams that occur more than once in a document; the rules
bound the share of characters inside such n-grams, and inside lines that repeat an earlier line. The work is
per document, so the job is one narrow pass over whole texts without any shuffle; a task holds one slice of at
most 8 MB of text, or one document.

Null and empty texts have no words and fail the base rule. Repeated rows are judged alike. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .words import SPACE, Words, covered, flags, mix, slices, sums, text_bytes

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, "


@dataclass(frozen=True)
class Rules:
    """A document is kept if it passes the base rule and stays within every limit."""

    min_words: int = 50
    max_repeat_words: float = 0.5
    #: n-gram length in words -> largest share of word characters inside n-grams that occur more than once.
    max_coverage: tuple[tuple[int, float], ...] = ((5, 0.4), (7, 0.35), (10, 0.3))
    max_dup_line_chars: float = 0.3
    max_symbols_per_word: float = 0.3


SYMBOL = flags(b"#*$%&|<>")
FIRST = ~flags(range(0x80, 0xC0))


def repeated(words: Words, n: int) -> np.ndarray:
    """Which words lie in an ``n``-word window that occurs at least twice in the same document."""
    at, hashes = words.windows(n)
    keys = mix(hashes ^ words.documents[at].astype(np.uint64))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return covered(at[twice], n, len(words))


def duplicate_lines(col: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word that equal an earlier line, and the characters in them."""
    lists = pc.split_pattern(col, "\n")
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(col)), np.diff(lists.offsets.to_numpy()))
    worded = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    keys = doc.astype(np.int64) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    keys, doc = keys[worded], doc[worded]
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    chars = pc.utf8_length(flat).to_numpy(zero_copy_only=False)[worded]
    n = len(col)
    return np.bincount(doc[later], minlength=n), np.bincount(doc[later], weights=chars[later], minlength=n).astype(np.int64)


def measure(col: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    col = pc.fill_null(col, "")
    words = Words(col)
    data, offsets = text_bytes(col)
    visible = FIRST[data] & ~SPACE[data]
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
    dup_lines, dup_line_chars = duplicate_lines(col)
    out = {
        "n_words": words.counts,
        "word_chars": sums(visible, offsets),
        "n_symbols": sums(SYMBOL[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": sums(repeated(words, 3), words.starts),
        "dup_line_chars": dup_line_chars,
    }
    for n in lengths:
        out[f"dup_{n}gram_chars"] = sums(repeated(words, n) * chars, words.starts)
    return out


def quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text", column: str = "quality") -> DataFrame:
    """``docs`` with the struct ``column``: the measures, ``base_failed`` and ``kept``.

    A column of that name is replaced."""
    lengths = tuple(n for n, _ in rules.max_coverage)
    kind = MEASURES + ", ".join(f"dup_{n}gram_chars long" for n in lengths)
    names = [x.split()[0] for x in kind.split(", ")]
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, StructType.fromDDL(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = measure(part.column(text), lengths)
                struct = pa.StructArray.from_arrays([pa.array(found[n], pa.int64()) for n in names], names)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, column])

    q = lambda name: F.col(column)[name]
    base = (q("n_words") < rules.min_words) | (q("n_repeat_words") > F.lit(rules.max_repeat_words) * q("n_words"))
    bad = (q("dup_line_chars") > F.lit(rules.max_dup_line_chars) * q("word_chars")) | (
        q("n_symbols") > F.lit(rules.max_symbols_per_word) * q("n_words")
    )
    for n, share in rules.max_coverage:
        bad = bad | (q(f"dup_{n}gram_chars") > F.lit(share) * q("word_chars"))
    out = docs.mapInArrow(run, schema)
    return out.withColumn(column, F.col(column).withField("base_failed", base).withField("kept", ~base & ~bad))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    judged = quality(docs, rules, column="_rm_quality")
    return judged.where("_rm_quality.kept").drop("_rm_quality")

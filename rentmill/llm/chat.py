"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turns in order, as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so control strings in a text can't end its turn, and unescaping gives
the text back. The rendered text is encoded once, with offsets; a token is under the loss mask if it lies in a span
of assistant text, which a binary search over the sorted spans decides. The whole head of an assistant's turn, with
its newline, is one special token, so no token holds the end of the head and the start of the text.

Encoding is that of ``bpe``, which keeps what it has encoded: rendered texts are cut at special tokens, many
conversations' stretches between them are encoded at a time, and offsets follow from the lengths of the tokens'
bytes. A token of a part of a character has that character's offsets.

Rows are dealt by conv_id and sorted by turn inside their task, and rendered as they stream by, so no conversation is
gathered in a list: one that is longer than ``PIECE`` characters is encoded in pieces that end where a turn ends (the
markers are special tokens, at which the encoder splits anyway), and a piece is the unit of the output.

Null roles and texts count as empty. Turns that tie are ordered by role, then text; null turns come first. A null
conv_id is a conversation like any other. Extra columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Encoder, Vocabulary, gather

START, END = "<|im_start|>", "<|im_end|>"
#: Of special tokens that start at the same place the encoder takes the longest.
HEAD = f"{START}assistant\n"
PIECE = 1 << 20
OUT = "conv_id long, piece long, last boolean, n_turns long, formatted string, ids array<int>, loss_mask array<boolean>, offsets array<int>"

_special = re.compile(f"({re.escape(HEAD)}|{re.escape(START)}|{re.escape(END)})")
_turn = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans in it of assistant texts, sorted."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted text was rendered from."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def mask(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which tokens, given by their (start, end) offsets, lie inside one of the sorted (start, end) spans."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= spans[at, 1]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, loss: np.ndarray) -> list[str]:
    """The stretches of text under the mask, in order. Tokens that share a character overlap and count it once."""
    chosen = offsets[loss]
    if not len(chosen):
        return []
    first = np.nonzero(np.concatenate(([True], chosen[1:, 0] > chosen[:-1, 1])))[0]
    last = np.append(first[1:], len(chosen)) - 1
    return [formatted[a:b] for a, b in zip(chosen[first, 0].tolist(), chosen[last, 1].tolist(), strict=True)]


class ChatEncoder:
    """The vocabulary with the three special tokens, which have the next free ids if it hasn't got them."""

    def __init__(self, content: bytes) -> None:
        self.encoder = Encoder(Vocabulary(content))
        v = self.encoder.vocabulary
        free = iter(range(len(v.bytes), len(v.bytes) + 3))
        self.special = {s: v.special[s] if s in v.special else next(free) for s in (START, END, HEAD)}
        self.size = np.zeros(max([len(v.bytes), *(i + 1 for i in self.special.values())]), np.int64)
        self.size[: len(v.bytes)] = v.token_size
        for s, i in self.special.items():
            self.size[i] = len(s)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all texts, each text's number of tokens, and the (start, end) offsets in the texts, all joined."""
        parts = [_special.split(t) for t in texts]
        stretches = pa.array([x for p in parts for x in p[::2]], pa.string())
        ids, counts = self.encoder.encode(stretches)
        # Stretches and special tokens alternate in each text.
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        sizes = np.ones(int(lengths.sum()), np.int64)
        inside = np.arange(len(sizes)) - np.repeat(ends - lengths, lengths)
        sizes[inside % 2 == 0] = counts
        between = np.array([self.special[x] for p in parts for x in p[1::2]], np.uint32)
        starts = np.empty(len(sizes), np.int64)
        starts[inside % 2 == 0] = np.cumsum(counts) - counts
        starts[inside % 2 == 1] = len(ids) + np.arange(len(between))
        tokens = gather(np.concatenate((ids, between)), starts, sizes, np.arange(len(sizes)))
        edges = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        point = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        stop = np.cumsum(self.size[tokens])
        offsets = np.stack((point[stop - self.size[tokens]], point[stop - 1] + 1), axis=1) if len(tokens) else np.empty((0, 2), np.int64)
        return tokens, np.diff(edges), offsets


@lru_cache(maxsize=1)
def _encoder(content: bytes) -> ChatEncoder:
    """Built once a worker process, whose tasks share what it keeps."""
    return ChatEncoder(content)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def format_conversations(rows: DataFrame, vocabulary_path: str, piece_chars: int = PIECE) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as formatted conversations: conv_id, piece, last, n_turns (of the piece),
    formatted, ids, loss_mask, and offsets, (start, end) by token, flat."""
    content = rows.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_bytes())
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        ready: list[tuple] = []
        held = 0

        def piece(conv: int | None, number: int, last: bool, turns: list[tuple[str, str]]) -> None:
            nonlocal held
            ready.append((conv, number, last, len(turns), *render(turns)))
            held += len(ready[-1][4])

        def flush() -> pa.RecordBatch:
            nonlocal held
            held = 0
            convs, numbers, lasts, n_turns, texts, spans = zip(*ready, strict=True)
            ready.clear()
            tokens, counts, offsets = encoder.encode(list(texts))
            lengths = np.array([len(t) for t in texts])
            base = np.cumsum(lengths) - lengths
            inside = [np.array(s, np.int64).reshape(-1, 2) + b for s, b in zip(spans, base.tolist(), strict=True)]
            loss = mask(np.concatenate(inside), offsets)
            offsets = offsets - np.repeat(base, counts)[:, None]
            columns = [
                pa.array(convs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(lasts, pa.bool_()), pa.array(n_turns, pa.int64()), pa.array(texts, pa.string()),
                _lists(tokens.astype(np.int32), counts, pa.int32()), _lists(loss, counts, pa.bool_()), _lists(offsets.ravel().astype(np.int32), 2 * counts, pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in OUT.split(", ")])

        now: object = None
        turns: list[tuple[str, str]] = []
        number = chars = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != now:
                    piece(now, number, True, turns)
                    turns, number, chars = [], 0, 0
                elif chars > piece_chars:
                    piece(now, number, False, turns)
                    turns, number, chars = [], number + 1, 0
                now = conv
                turns.append((role, text))
                chars += len(text)
                if held > piece_chars:
                    yield flush()
        if turns:
            piece(now, number, True, turns)
        if ready:
            yield flush()

    return rows.mapInArrow(run, OUT)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back, one row a conversation: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. The pieces of a conversation must follow each other in one partition,
    as ``format_conversations`` leaves them."""
    import hashlib

    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns_sha, loss_sha, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            out = []
            conv, last = batch.column("conv_id").to_pylist(), batch.column("last").to_pylist()
            offsets = batch.column("offsets").flatten().to_numpy().reshape(-1, 2)
            loss = batch.column("loss_mask").flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.cumsum(batch.column("loss_mask").value_lengths().to_numpy()))).tolist()
            for k, formatted in enumerate(batch.column("formatted").to_pylist()):
                for role, text in parse(formatted):
                    turns_sha.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                mine = slice(edges[k], edges[k + 1])
                for part in masked_text(formatted, offsets[mine], loss[mine]):
                    text = unescape(part)
                    loss_sha.update(text.encode())
                    loss_chars += len(text)
                chars += len(formatted)
                if last[k]:
                    out.append((conv[k], n_turns, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))
                    turns_sha, loss_sha, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            names = [f.split()[0] for f in kind.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return formatted.select("conv_id", "last", "formatted", "loss_mask", "offsets").mapInArrow(run, kind)

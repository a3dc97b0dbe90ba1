"""The registered queries themselves, and the parts of operators that small tables in test_llm don't reach."""

from __future__ import annotations

import hashlib
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession, functions as F

import __spark_entry__ as entry
from rentmill.llm import exact_dedup, jaccard_join, langid, mixing, substring_dedup, warc
from rentmill.llm.queries import QUERIES, SQL, vocabulary_path

from .test_llm import brute_components, words

SMALL = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SMALL.exists(), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def documents(spark: SparkSession) -> dict[int, str | None]:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark: SparkSession, name: str) -> None:
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(SMALL))
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rows: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(got.select(columns).collect()) == plain(want.fetchall())


def held_out(doc_id: int, n: int, which: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % n == which


@needs_tables
def test_op1(spark: SparkSession, documents: dict[int, str | None]) -> None:
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op1_langid"](spark, str(SMALL)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and len(words(documents[r.doc_id])) >= 5]
    assert sum(judged) >= 0.9 * len(judged) > 10
    assert {r.lang_pred for r in rows} <= {v for v in lang.values() if v} | {"und"}


@needs_tables
def test_op2(spark: SparkSession, documents: dict[int, str | None]) -> None:
    rows = QUERIES["op2_ppm"](spark, str(SMALL)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r.held_out == held_out(r.doc_id, 7, 2) and r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.train_tokens for r in rows} == {sum(len(words(t)) + 1 for d, t in documents.items() if not held_out(d, 7, 2))}
    assert all(r.n_tokens == len(words(documents[r.doc_id])) + 1 for r in rows)


@needs_tables
def test_op5(spark: SparkSession, documents: dict[int, str | None]) -> None:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rows = QUERIES["op5_bpe"](spark, str(SMALL)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        ids = library.encode(documents[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def small_net() -> tuple[langid.Network, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (6, 24)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    return langid.train(x, y, ["a", "b", "c"], langid.Settings(window=24, filters=3, epochs=2, batch=6)), x, y


def naive(net: langid.Network, window: np.ndarray) -> np.ndarray:
    """Log-probabilities of one window, byte by byte."""
    pooled = []
    for table in net.filters:
        for f in range(table.shape[2]):
            pooled.append(max(sum(float(table[k, window[i + k], f]) for k in range(len(table))) for i in range(len(window) - len(table) + 1)))
    hidden = [max(0.0, p + float(b)) for p, b in zip(pooled, net.bias, strict=True)]
    z = [sum(h * float(w) for h, w in zip(hidden, net.weights[:, j], strict=True)) + float(net.offset[j]) for j in range(len(net.languages))]
    return np.array(z) - np.log(np.exp(np.array(z) - max(z)).sum()) - max(z)


def test_network_is_a_convolution() -> None:
    net, x, _ = small_net()
    np.testing.assert_allclose(langid.Predictor(net).log_probabilities(x), [naive(net, w) for w in x], atol=1e-4)


def test_a_training_step_follows_the_gradient() -> None:
    """The first Adam step moves each parameter by the rate, against the sign of the numeric gradient."""
    s = langid.Settings(window=24, filters=3, epochs=1, batch=6, rate=1e-3)
    _, x, y = small_net()
    start = langid.train(x, y, ["a", "b", "c"], langid.Settings(window=24, filters=3, epochs=0, batch=6))
    after = langid.train(x, y, ["a", "b", "c"], s)
    loss = lambda net: -np.mean([naive(net, w)[k] for w, k in zip(x, y, strict=True)])
    checked = pooled = 0
    of = lambda net: {"weights": net.weights, "offset": net.offset, "bias": net.bias} | {f"filters {len(f)}": f for f in net.filters}
    used = {n: sorted({(k, int(b), f) for k in range(int(n[-1])) for b in np.unique(x) for f in range(3)}) for n in of(start) if n.startswith("filters")}
    for name, values in of(start).items():
        moved = of(after)[name] - values
        places = used[name][:: 1 + len(used[name]) // 150] if name in used else np.ndindex(values.shape)
        for at in places:
            old = values[at]
            values[at] = old + 1e-2
            up = loss(start)
            values[at] = old - 1e-2
            down = loss(start)
            values[at] = old
            if abs(up - down) > 1e-4:
                assert np.sign(moved[at]) == -np.sign(up - down), (name, at)
                checked += 1
                pooled += name in used
    assert checked > 30 and pooled > 12


def test_a_text_is_the_mean_of_its_windows(monkeypatch: pytest.MonkeyPatch) -> None:
    """Texts of no, one and many windows, the last of them short, however many are looked at together."""
    net, _, _ = small_net()
    texts = ["", "short", "x" * 24, "Der schnelle Fuchs springt, and then some more. " * 9, "ab" * 12 + "c"]
    want = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        cut = [np.pad(data[i : i + 24], (0, max(0, 24 - len(data) + i))) for i in range(0, len(data), 24)]
        z = np.mean([naive(net, w) for w in cut], axis=0) if cut else np.zeros(3)
        want.append((int(z.argmax()), float(np.exp(z - np.log(np.exp(z).sum())).max())))
    for block in (4096, 3):
        monkeypatch.setattr(langid, "BLOCK", block)
        found, score = langid.Predictor(net).predict(pa.array(texts))
        assert found.tolist() == [k for k, _ in want] and score == pytest.approx([p for _, p in want], abs=1e-4)


def test_a_long_text_needs_little_memory() -> None:
    net, _, _ = small_net()
    text = pa.array(["lorem ipsum " * 1_000_000, "x"])
    tracemalloc.start()
    windows = langid.Windows(text, 256)
    peaks = [windows.cut(slice(k, k + langid.BLOCK)).shape for k in range(0, len(windows), langid.BLOCK)]
    assert sum(n for n, _ in peaks) == len(windows) == 46_876 and tracemalloc.get_traced_memory()[1] < 48 << 20
    tracemalloc.stop()


def test_rare_labels_are_not_learned(spark: SparkSession) -> None:
    rows = [(i, "the and of " * 9, "en") for i in range(20)] + [(100 + i, "el los una " * 9, "es") for i in range(20)] + [(200 + i, "x y z", f"dirty{i}") for i in range(9)]
    net = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Settings(epochs=1, labels=2))
    assert net.languages == ["en", "es"]


REPEATED = [
    (1, "a b c d e f g", "s", 1), (1, "a b c d e f g", "s", 2), (1, "other words are in this one here", "s", 3), (1, "A b c d e f g", "t", 4),
    (None, "a b c d e f g", "s", 5), (None, "nobody has this text but me here", None, 6), (None, "nobody has this text but me here", None, 7), (None, None, None, 8), (2, "", "t", 9),
]


@pytest.fixture
def repeated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPEATED, "doc_id long, text string, source string, extra int")


def test_rows_that_share_a_doc_id(repeated: DataFrame) -> None:
    """Rows of one doc_id with different texts, and rows without doc_id, are told apart, and what stays never changes."""
    for keep, want in (
        (jaccard_join.keep_one, {(1, "a b c d e f g"), (1, "other words are in this one here"), (None, "nobody has this text but me here"), (None, None), (2, "")}),
        (exact_dedup.keep_first, {(1, "a b c d e f g"), (1, "other words are in this one here"), (1, "A b c d e f g"), (None, "nobody has this text but me here"), (2, "")}),
    ):
        first = sorted(map(str, keep(repeated).collect()))
        rows = keep(repeated.repartition(4, "extra")).collect()
        assert sorted(map(str, rows)) == first
        if keep is jaccard_join.keep_one:  # of near copies with one doc_id either text may stand for both
            assert Counter((r.doc_id, (r.text or "").lower()) for r in rows) == Counter((d, (t or "").lower()) for d, t in want)
        else:
            assert Counter((r.doc_id, r.text) for r in rows) == Counter(want)


def test_mixing_tells_repeated_rows_apart(repeated: DataFrame) -> None:
    taken = Counter()
    for r in mixing.plan(repeated).collect():
        taken[r.doc_id, r.source, r.size] += r.taken
    first = sorted(map(str, mixing.mixed(repeated).collect()))
    rows = mixing.mixed(repeated.repartition(4, "extra")).collect()
    assert sorted(map(str, rows)) == first
    given = Counter()
    for r in rows:
        given[r.source] += len(words(r.text))
    assert given == +Counter({s: sum(n for (_, x, _), n in taken.items() if x == s) for s in {r[2] for r in REPEATED}})


def test_near_duplicates_without_doc_id(spark: SparkSession) -> None:
    texts = {i: f"w{i // 3} " + " ".join(f"x{i // 3}_{k}" for k in range(40)) + (f" y{i % 3}" if i % 3 else "") for i in range(30)}
    rows = [(None if i % 2 else i, t) for i, t in texts.items()]
    found = jaccard_join.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    smallest = {r.component_id for r in found}
    for i, home in brute_components(texts).items():
        assert min(k for k in range(home, home + 3) if not k % 2) in smallest
    assert all(r.n_links == 2 for r in found)


def test_substring_dedup_spreads_rows_without_doc_id(spark: SparkSession) -> None:
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(None, f"a{i} {passage} b{i}") for i in range(6)] + [(7, f"c {passage} d")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == Counter({(None, 20): 6, (7, 0): 1})
    alone = substring_dedup.remove_repeats(spark.createDataFrame(rows[:6], "doc_id long, text string")).collect()
    assert [r.n_removed for r in alone] == [0] * 6


def test_warc_without_page_ids(spark: SparkSession) -> None:
    pages = [(None, "b", "same"), (None, "a", "same"), (None, "c", "with"), (3, "d", "with"), (None, "e", "alone")]
    index = warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read_archive(index).collect())
    assert got == Counter([
        (None, "a", "response", None), (None, "b", "revisit", None), (None, "c", "revisit", 3), (3, "d", "response", None), (None, "e", "response", None),
    ])

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, score int, quality string, `order` int, kept string, ids string"


def made(seed: int = 3) -> list[tuple]:
    """Documents with copies, near copies, shared passages, repeated lines, empty, null and long texts, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(30, 160)) for _ in range(25)]
    passage = text(40)
    out = [*base, *base[:5], base[0].upper(), base[1].replace(" ", "\n"), "  " + base[2]]
    for t in base[:8]:
        parts = t.split()
        parts[len(parts) // 2] = "changed"
        out += [" ".join(parts), " ".join(parts[:-2])]
    out += [f"{text(30)} {passage} {text(20)}" for _ in range(4)]
    out += [None, "", " \n\t", "one", "two words", "one", "a b c d e", "x " * 3000, text(4000), "line again\n" * 40 + text(60), "# * $ % " * 30]
    out += ["Zeile\x0beins\x1czwei drei 🙂 <|endoftext|> 's", "É ß İ"]
    rows = [
        (i, t, [None, "aa", "bb"][i % 3], [None, "s1", "s2", "s1", "s1"][i % 5], None if t is None else len(t), "clash", i, "clash", i, "clash", "clash")
        for i, t in enumerate(out)
    ]
    return [*rows, rows[3], rows[3], (None, base[4], None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(made(), KIND).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KIND)

"""The pipeline's stages, each on its own input and one after the other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

import corpus_pipeline
from rentmill.llm.queries import vocabulary_path

from .test_llm import brute_components, words


def test_stages_keep_columns_and_accept_anything(spark: SparkSession, docs: DataFrame, empty: DataFrame) -> None:
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() <= 3 * docs.count()
        assert stage(spark, empty, "").count() == 0


def test_run(spark: SparkSession, docs: DataFrame, tmp_path) -> None:  # noqa: ANN001
    table = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    kept = table
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
    rows = kept.collect()
    left = {r.doc_id: r.text for r in rows}
    assert len(left) == len(rows) and set(brute_components(left).values()) == set(left)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(vocabulary_path())
    assert {r.doc_id for r in out} <= set(left) and all(r.round_trip for r in out)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode(left[r.doc_id], add_special_tokens=False).ids for r in out)
    sizes = {d: len(words(t)) for d, t in left.items()}
    largest = {r.source: max(sizes[x.doc_id] for x in rows if x.source == r.source) for r in rows}
    assert abs(sum(sizes[r.doc_id] for r in out) - sum(sizes.values())) <= sum(n / 2 + 1 for n in largest.values())

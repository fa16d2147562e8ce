"""The whole pipeline over a table without rows, and over one of a single document, which language ID learns from."""

import pytest

import corpus_pipeline
from tests.llm.test_dedup import DOCS
from tidemark.llm import mixing


@pytest.mark.parametrize("n", [0, 1])
def test_few_documents(spark, tmp_path, n):
    text = " ".join(f"word{i}" for i in range(2 * mixing.BLOCK_WORDS))  # less than half a block would be mixed to nothing
    spark.createDataFrame([(0, text, "en", "web", len(text))][:n], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == ({0} if n else set())

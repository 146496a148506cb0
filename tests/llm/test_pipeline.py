from pathlib import Path

import pytest

import corpus_pipeline
from tessera.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == columns
            assert 0 < docs.count() <= kept
            assert docs.select("doc_id").distinct().count() == docs.count()
            kept = docs.count()
    assert docs.select("doc_id").distinct().count() == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "personal_data", "packing"]


def test_stages_of_no_documents(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0

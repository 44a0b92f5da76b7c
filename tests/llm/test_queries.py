"""Every registered corpus query, and those with SQL against it."""

from __future__ import annotations

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from shoalwise.llm.checks import ORACLES
from shoalwise.llm.queries import QUERIES
from tools.compare import differences, sql_frame


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        assert differences(got, sql_frame(sf, ORACLES[name])) == ""


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        assert 0 < docs.count() <= kept
        kept = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == kept and set(columns) < set(last.columns)
    assert last.where("taken > 2 * size").count() == 0


def test_pipeline_stages_on_awkward_documents(spark, awkward, empty, sf):
    for docs in (awkward, empty):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert len(rows) <= docs.count(), name
            if i < 4:
                assert out.columns == docs.columns, name

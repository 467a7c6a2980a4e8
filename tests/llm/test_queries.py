"""Registered queries of faultloom.llm against their SQL, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from faultloom.llm import decontaminate, mixing, neardup, oracle, queries, repeats, toxicity
from oracle_check import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(spark, con, name):
    problems = differences(queries.QUERIES[name](spark, SF), con, oracle.SQL[name])
    assert [p for p in problems if p != "no rows"] == []


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 1 + len(queries.QUERIES))]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).persist()
        old = {r.doc_id: r for r in before.collect()}
        new = {r.doc_id: r for r in after.collect()}
        assert set(new) <= set(old)
        if name == "toxicity":
            scores = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet")), out_col="p").collect()
            assert set(new) == {r.doc_id for r in scores if r.p < toxicity.THRESHOLD}
        if name == "near duplicates":
            assert set(new) == {r._id for r in neardup.classes(before).collect() if r._id == r.component_id}
        if name == "repeated strings":
            assert set(new) == set(old)
            gone = {r._id: r.n_removed for r in repeats.measure(before).collect()}
            assert all((new[i].text == old[i].text) == (gone[i] == 0) and new[i].n_chars == len(new[i].text) for i in new)
        if name == "decontamination":
            hits = decontaminate.find_hits(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
            assert set(new) == {r._id for r in hits if not r.spans}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        before = after
    assert set(columns) <= set(before.columns) and before.count() > 0
    assert {r.epoch for r in before.collect()} <= set(range(mixing.Targets().max_epochs))

import os

import pytest

import corpus_pipeline
from graphloom.llm import classifier, mixing, outliers, registry, setjoin
from oracle import differences, duck

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@here
def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        rows = [tuple(r) for r in out.collect()]
        if name == "quality_rules":
            kept = {r.doc_id for r in outliers.assess(docs).collect() if r.keep}
            assert sorted(rows) == sorted(r for r in before if r[0] in kept) and len(rows) < len(before)
        elif name == "quality_classifier":
            kept = {r.doc_id for r in classifier.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.keep}
            assert sorted(rows) == sorted(r for r in before if r[0] in kept)
        elif name == "near_duplicates":
            left = {r[0] for r in rows}
            assert left == {r.class_id for r in setjoin.classes(docs).collect()} and len(left) == len(rows)
        elif name == "mix":
            assert len(rows) == mixing.mix(docs).count()
        else:
            assert sum(r[5] for r in rows) == sum(len((r[1] or "").split()) for r in before)
            continue
        assert out.dtypes == kinds
        path = mixing.settle(out)
        docs = path


@here
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_sql(spark, name):
    more, less, n = differences(registry.queries()[name](spark, SF), duck(SF), registry.oracle_sql()[name])
    assert (more, less) == ([], []) and n > 0

"""The pipeline's stages, each on its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from veilsift.llm.minhash import near_duplicates
from veilsift.llm.quality import quality
from veilsift.llm.secrets import find_secrets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(stage(spark, inputs[-1], sf_dir).cache())
    start, good, unique, clean, mixed, packed = inputs
    assert all(x.columns == docs.columns for x in inputs[:-1])
    kept = {r["doc_id"] for r in quality(start).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    groups = {r["component_id"] for r in near_duplicates(good).collect()}
    assert Counter(r["doc_id"] for r in unique.collect()) == Counter(groups)
    assert clean.count() == unique.count() and find_secrets(clean).where("spans <> ''").isEmpty()
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= groups and max(times.values()) <= 2
    pieces = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    assert pieces == times


@pytest.mark.parametrize("table", ["edges", "edges_clash", "nothing"])
def test_stages_on_odd_rows(request, spark, sf_dir, table):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        kept = Counter((r["doc_id"], r["source"]) for r in got.collect())
        assert got.columns == docs.columns
        given = Counter((r["doc_id"], r["source"]) for r in rows)
        if name == "source_mixing":
            assert all(n <= 2 * given[k] for k, n in kept.items())
        else:
            assert kept <= given
        if name == "secret_scan":
            assert kept == given
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == len(rows)


def test_run_equals_its_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("piece = 0").count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mixing", "best_fit_packing"]

from __future__ import annotations

import pytest

import corpus_pipeline
from tidemark.llm.secret_scan import scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    top = tmp_path_factory.mktemp("stages")
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(f"{top}/{name}")
        after = spark.read.parquet(f"{top}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [n for n, *_ in stages] == ["quality", "near_dedup", "decontaminate", "mask_secrets", "mix"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_only_the_secrets_stage_changes_texts(stages):
    for name, before, after in stages:
        kept = after.select("doc_id", "text").join(before.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count()
        assert (kept > 0) == (name == "mask_secrets")


def test_decisions_take_effect(stages, spark):
    by = {n: (b, a) for n, b, a in stages}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = by["quality"]
    assert before.count() > after.count() > 0.7 * before.count()
    told = before.join(labels.where("quality is not null"), "doc_id").join(after.selectExpr("doc_id", "1 as kept"), "doc_id", "left").collect()
    assert sum(r.quality == (r.kept or 0) for r in told) / len(told) > 0.95
    before, after = by["mask_secrets"]
    assert after.count() == before.count() and scan(after).where("size(base) > 0").count() == 0
    before, after = by["mix"]
    assert after.where("taken <> copies * size or copies < 1 or copies > 3").count() == 0


def test_run_gives_the_last_stage(stages, spark):
    rows = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1][2])

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import quality

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_windows(items):
    split = [w for w in map(plain_words, items) if w]
    return {tuple(w[i : i + min(10, len(w))]) for w in split for i in range(len(w) - min(10, len(w)) + 1)}


def test_decontaminate_keeps_what_holds_no_window(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    windows = plain_windows(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    sizes = {len(w) for w in windows}
    texts = {r.doc_id: plain_words(r.text) for r in docs.collect()}
    clean = [k for k, w in texts.items() if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))]
    assert 0 < len(clean) < len(texts)
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, SF).select("doc_id").collect()) == sorted(clean)


#: What operators call their own columns, inside and outside.
NAMES = """mix_size mix_mix_size mix_taken SIZE_ score predicted n_words n_hit n_items items contaminated size source_size target copies taken _h _runs spans base
doc h row key r1 r2 cs w wid sid _id _text x at token fp component_id _row _tm_h _tm_runs _keep_0 t0 last""".split()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark, corpus):
    """The test corpus (nulls, empty and long texts, repeats, ties) after some labelled documents, with a column of each name."""
    plain = spark.createDataFrame([r for r in corpus], "doc_id long, text string, lang string, source string, n_chars long").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    both = spark.read.parquet(f"{SF}/documents.parquet").unionByName(plain)
    return both.select("*", *[F.concat(F.lit(n + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in NAMES])


def test_any_column_passes_through(spark, corpus, tmp_path):
    docs = odd(spark, corpus)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mix" or len(out.columns) == len(docs.columns))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        wrong = [F.col(n) != F.concat(F.lit(n + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for n in NAMES]
        assert out.count() > 0 and out.where(F.greatest(*[w.cast("int") for w in wrong]) == 1).count() == 0
        docs = out


def test_empty_tables(spark, corpus):
    docs = odd(spark, corpus).limit(0).cache()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_quality_keeps_what_the_ranking_accepts(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ranking = quality.fit(docs, labels)
    rows = docs.collect()
    want = sorted(r.doc_id for r in rows if ranking.score(quality.np.array([quality.features(r.text or "")]))[0] >= 0.3)
    assert 0 < len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.good_quality(spark, docs, SF).select("doc_id").collect()) == want


def test_secrets_are_masked_and_nothing_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    spans = {r.doc_id: r.spans for r in corpus_pipeline.secret_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = {}
    for r in docs:
        covered = set()
        for s in spans[r.doc_id]:
            covered |= set(range(s.start, s.end))
        out, inside = [], False
        for i, c in enumerate(r.text or ""):
            if i in covered:
                out.append("" if inside else "[secret]")
            else:
                out.append(c)
            inside = i in covered
        want[r.doc_id] = "".join(out)
    got = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert got == want and any("[secret]" in t for t in got.values())


def test_mix_takes_whole_documents_near_each_target(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    by: dict = {}
    for r in got:
        assert (r.source, r.size) == sizes[r.doc_id] and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    for source, rows in by.items():
        total = sum(n for s, n in sizes.values() if s == source)
        largest = max(n for s, n in sizes.values() if s == source)
        assert rows[0].source_size == total and abs(sum(r.taken for r in rows) - rows[0].target) <= largest

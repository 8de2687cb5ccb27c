from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tidemark.llm import near_copies

SF = "/root/testdata/sf0.001"


def plain_set(text, width=5):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def plain_kept(rows, least=0.8):
    """Keys that stay: the least (nulls last) of every group that pairs of a similarity of ``least`` connect."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        order = (k is None, k or 0)
        best[find(i)] = min(order, best.get(find(i), order))
    return sorted(best.values())


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


@pytest.mark.parametrize("together", [256, 1])
def test_matches_brute_force(docs, corpus, monkeypatch, together):
    monkeypatch.setattr(near_copies, "TOGETHER", together)
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns and kept(got) == plain_kept([r[:2] for r in corpus])


def test_sets_that_meet_without_their_least(spark):
    """Texts of common runs in many mixes: most that meet are not alike, and chains connect some."""
    r = random.Random(11)
    parts = [" ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(12)) for _ in range(14)]
    rows = []
    for i in range(120):
        pick = r.sample(parts, 9)
        rows += [(3 * i, " ".join(pick)), (3 * i + 1, " ".join(pick[:-1] + r.sample(parts, 1)))]
    assert kept(near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_kept(rows)


def edited(n_texts=30, seed=3):
    """Pairs (2i, 2i + 1) of a text and its copy with some words changed, of similarities from about 0.6 to 1."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(n_texts):
        words = [word() for _ in range(r.choice([40, 100, 200, 1000]))]
        copy = list(words)
        for at in r.sample(range(len(words)), max(1, len(words) * (i % 5) // 100)):
            copy[at] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    return rows


def test_the_stage_drops_every_pair_at_the_similarity(spark):
    rows = edited()
    near = [similarity(plain_set(rows[2 * i][1]), plain_set(rows[2 * i + 1][1])) for i in range(len(rows) // 2)]
    assert sum(0.8 <= x < 0.95 for x in near) > 5 and sum(x < 0.8 for x in near) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(corpus_pipeline.near_dedup(spark, docs, SF)) == plain_kept(rows)


def test_the_stage_matches_brute_force_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert kept(corpus_pipeline.near_dedup(spark, docs, SF)) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(no_docs):
    assert near_copies.one_of_each(no_docs).count() == 0

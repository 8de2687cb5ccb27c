from __future__ import annotations

import re

import pytest

from tidemark.llm import decontam
from tidemark.llm.shared import LOWER, UPPER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(str.maketrans(UPPER, LOWER)))


def plain(rows, items, size=10):
    out = []
    for i, t in rows:
        w, hit, seen = words(t), set(), set()
        for name, x in items:
            v = words(x)
            n = min(size, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        seen.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), sorted(seen), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (2, "short two here"), (3, "Ünïcode  WORD-1"), (10, None), (11, "..."), (None, "nobody knows it"), (12, "x " * 15), (13, "solo")]
TEXTS = [
    "pre Alpha, beta GAMMA delta\nepsilon zeta eta theta iota kappa lambda mu post",
    "alpha beta gamma delta epsilon zeta eta theta iota",
    "beta gamma delta epsilon zeta eta theta iota kappa lambda",
    "a short-one and a short two here; short one",
    "ünïcode word 1", "Ünïcode word 1", "nobody knows it", "x " * 40, "solo solo", "", None, "clean text of other words", "lambda mu alpha beta",
]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_matches_brute_force(spark, clash, limit):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (0, "other text, same id: solo"), (None, "short one")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = clash(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = decontam.contamination(docs, bench, broadcast_rows=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in got), key=str) == plain(rows, ITEMS)
    assert all(r.n_items == len(r["items"]) for r in got)


def test_whole_corpus(docs, corpus, spark):
    items = [(i, " ".join((corpus[i][1] or "").split()[5:25])) for i in range(0, 60, 6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in got), key=str) == plain([r[:2] for r in corpus], items)


def test_no_benchmark_no_documents_and_kept_columns(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none).where("contaminated").count() == 0
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(no_docs, bench).count() == 0
    kept = decontam.contamination(docs, bench, keep=["doc_id", "text", "key", "w"])
    assert sorted(map(str, kept.select("doc_id", "text", "key", "w").collect())) == sorted(map(str, docs.select("doc_id", "text", "key", "w").collect()))

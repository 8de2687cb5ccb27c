from __future__ import annotations

import re

import pytest

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        level = {s: rest * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in level if level[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else level[s] for s in names}
        full |= over


def test_targets_sizes_and_nearness(docs, corpus):
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, _, s, _ in corpus:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    assert len(got) == len(corpus)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    # Sources of some twenty documents, of which one has 8000 of 9670 words and can't be taken in part.
    for s, n in taken.items():
        assert abs(n - want[s]) <= (0.1 * want[s] if s != "s2" else 4000)


def test_matches_sorted_sql(docs, corpus):
    """The same rule by running sums over sorted rows; the rows without an id apart, as SQL hashes none."""
    import duckdb
    import pandas as pd

    from tidemark.llm.oracles import MIX

    rows = [r for r in corpus if r[0] is not None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [r[0] for r in rows], "text": pd.array([r[1] for r in rows], "string"), "source": pd.array([r[3] for r in rows], "string")}))
    want = sorted((i, n, s, round(t, 6), k) for i, n, s, t, k in con.execute(MIX).fetchall())
    got = mixing.mix(docs.where("doc_id is not null")).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got) == want


def test_large_sources_come_within_a_thousandth(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', int(50 + id * 7919 % 400)) as text", "concat('s', id * id % 5) as source")
    off = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.001 * r["max(target)"] for r in off)


def test_reruns_and_partitions_agree(docs):
    one, two = (sorted(((r.doc_id or -1, r.source or "", r.taken) for r in mixing.mix(d).collect())) for d in (docs, docs.repartition(5)))
    assert one == two


def test_sources_stop_at_three_times(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 1000, "b")], "doc_id long, text string, source string")
    assert {r.source: (r.target, r.taken) for r in mixing.mix(docs).collect()} == {"a": (30.0, 30), "b": (980.0, 1000)}


def test_budgets_are_nested(spark):
    docs = spark.createDataFrame([(i, "w " * 7, "a") for i in range(40)], "doc_id long, text string, source string")
    base = docs.selectExpr("1L as sid", "7L as size", "doc_id as key").withColumn("h", mixing.place("key"))
    upto = []
    for budget in (0, 50, 100, 280, 500):
        goal = spark.createDataFrame([(1, budget)], "sid long, budget long")
        r = mixing.threshold(base, goal, 12, 3, True).first()
        assert r.used == min(280, budget // 7 * 7) == base.where(f"h < {r.upto}").count() * 7
        upto.append(r.upto)
    assert upto == sorted(upto)


def test_keep_and_empty(docs, no_docs):
    kept = mixing.mix(docs, keep=docs.columns)
    assert {"text", "lang", "n_chars", "taken"} <= set(kept.columns) and kept.count() == docs.count()
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(docs.where("doc_id in (301, 302)")).agg({"taken": "sum"}).first()[0] == 0

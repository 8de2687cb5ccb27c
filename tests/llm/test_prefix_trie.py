from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, shared


def plain(convs):
    """{conv: [(role, text)]} to the nodes, by walking every prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    leaf = {p: not any(q != p and q[: len(p)] == p for q in members) for p in members}
    out = []
    for p, held in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in held if len(convs[c]) == len(p))))
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), children, sum(leaf[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, convs, clash):
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_matches_walking_all_prefixes(spark, clash, seed, monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 10)
    r = random.Random(seed)
    convs = {c: [(r.choice(["user", ""]), r.choice(["", "a", "b", "ab", "é" * 30])) for _ in range(r.choice([0, 1, 2, 3, 9]))] for c in r.sample(range(-50, 900), 150)}
    hot = [("user", "hi")] + [("assistant", "x" * 99)] * 40
    convs |= {1000 + i: hot[: 41 - (i % 7) * (i % 3 == 0)] for i in range(80)}
    members = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = prefix_trie.trie(table(spark, convs, clash), ["turn"], members).collect()
    assert sorted(map(tuple, got), key=str) == plain(convs)


def test_members_in_several_lists(spark, clash, monkeypatch):
    convs = {c: [("u", "same")] for c in range(100)} | {c: [("u", "same"), ("a", str(c % 3))] for c in range(100, 120)}
    walk = prefix_trie._walk

    def short_lists(batches):
        prefix_trie.LISTED = 3
        return walk(batches)

    monkeypatch.setattr(prefix_trie, "_walk", short_lists)
    got = prefix_trie.trie(table(spark, convs, clash), ["turn"]).collect()
    assert sorted(map(tuple, got), key=str) == plain(convs)


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, None, None), (1, 0, "u", "b"), (1, 0, "u", "a"), (2, 5, "", ""), (None, 0, "u", "lost"), (2, 7, "u", "a"), (2, 7, "u", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = {1: [("", ""), ("u", "a"), ("u", "b")], 2: [("", ""), ("u", "a"), ("u", "a")]}
    assert sorted(map(tuple, prefix_trie.trie(frame, ["turn"]).collect()), key=str) == plain(convs)
    assert prefix_trie.trie(frame.limit(0), ["turn"]).count() == 0
    alone = prefix_trie.trie(frame.limit(0), ["turn"], frame.select("conv_id")).collect()
    assert [tuple(x)[:7] for x in alone] == [(1, 0, None, 2, 0, 1, 0)]


def test_query_rebuilds_conversations(spark, tmp_path):
    """Against the rule, conversation by conversation."""
    import zlib

    from tidemark.llm.queries import op12_trie

    r = random.Random(9)
    rows = [(c, None if t == 3 else t, r.choice(["user", None]), r.choice(["p", "q", None, "long " * 9])) for c in range(0, 60) if c % 7 for t in range(r.randint(1, 12))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    held = {}
    for c, t, role, text in rows:
        held.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    held = {c: [x[2:] for x in sorted(v)] for c, v in held.items()}
    convs = {}
    for c in held:
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = held.get(c - c % 5, [])[:h] + held[c][h:]
    assert sorted(map(tuple, op12_trie(spark, str(tmp_path)).collect()), key=str) == plain(convs)

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, shared
from tidemark.llm.naming import named


def plain(rows):
    """Rows grouped by their very texts; which of wholly equal rows stays is left open."""
    of = {}
    for i, text in rows:
        t = (text or "").encode().translate(None, b" \t\n\x0b\x0c\r")
        of.setdefault(t, []).append((i, len(text or "")))
    out = []
    for t, held in of.items():
        keep = min(held, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(i, keep[0], len(held), hashlib.sha256(t).hexdigest()) for i, _ in held]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 7, 64, 512])
def test_matches_grouping_by_text(docs, corpus, size, monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 10)  # the way of large tables, hot groups by broadcast
    rows = [r for r in corpus if size > 1 or len(r[1] or "") < 900]
    table = docs if size > 1 else docs.where(F.coalesce(F.length("text"), F.lit(0)) < 900)
    got = exact_dedup.groups(table, size=size).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain([r[:2] for r in rows])
    stays = [r for r in got if r.kept]
    assert len(stays) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in stays)


def test_blocks_that_differ_in_one_place(spark):
    """Texts of whole blocks, one short, one long, and with a block moved: equal parts never make them equal."""
    r = random.Random(4)
    block = ["".join(r.choice("ab") for _ in range(4)) for _ in range(3)]
    rows = [(i, "".join(r.choice(block) for _ in range(r.randint(0, 9)))[: r.randint(0, 40)]) for i in range(300)]
    rows += [(1000 + i, " ".join(t)) for i, t in rows[:100]]
    got = exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), size=4).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)


def test_ties_nulls_and_empty_tables(spark, no_docs):
    rows = [(5, "a b"), (3, "a\tb"), (None, "a b"), (3, "a\tb"), (9, "ab"), (4, None), (2, ""), (8, " \n"), (None, None)]
    got = exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in got) == sorted((i or 0, 3 if t and t.strip() else 8, 5 if t and t.strip() else 4) for i, t in rows)
    assert sum(r.kept for r in got) == 2
    assert exact_dedup.groups(no_docs).count() == 0


def test_other_keys(spark):
    rows = [("b", "x"), ("a", "x"), ("c", "y")]
    got = exact_dedup.groups(spark.createDataFrame(rows, "name string, body string"), text="body", key="name").collect()
    assert sorted((r.name, r.keep_id, r.kept) for r in got) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


@pytest.mark.parametrize("parts", [1, 5])
def test_names_are_dense_ranks(spark, parts):
    """Also where one key fills several tasks."""
    r = random.Random(parts)
    rows = [("hot" if i % 2 else r.choice("abcdexyz") * r.randint(0, 3), r.randrange(3), i) for i in range(3000)]
    got, n = named(spark.createDataFrame(rows, "s string, k int, i long").repartition(parts), ["s", "k"], ["i"], ["i", "s", "k"])
    order = {x: i + 1 for i, x in enumerate(sorted({x[:2] for x in rows}))}
    assert n == len(order) and {(x.i, x.name) for x in got.collect()} == {(i, order[s, k]) for s, k, i in rows}


def test_long_rows_go_to_python_in_small_batches(spark):
    from tidemark.llm import shared

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["id"])

    before = {k: spark.conf.get(k, None) for k in shared.SMALL_BATCH}
    with shared.small_batches(spark):
        got = [r.id for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "id long").collect()]
    assert max(got) == 1000 and sum(got) == 2500
    assert {k: spark.conf.get(k, None) for k in shared.SMALL_BATCH} == before

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import shared, simhash
from tidemark.llm.components import components
from tidemark.llm.shared import FOLD


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(FOLD))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=4):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(ids))]


def test_matches_brute_force(docs, corpus):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id").collect()
    prints = [plain_fingerprint(t) for _, t, *_ in corpus]
    parts = plain_components([r[0] for r in corpus], prints)
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(corpus, prints, parts, strict=True)), key=key)


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def near_prints(seed, n):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(6)]
    found = {0, (1 << 64) - 1, 1 << 63}
    while len(found) < n:
        x = r.choice(base)
        for _ in range(r.randint(0, 7)):
            x ^= 1 << r.randrange(64)
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize("crowd", [512, 3])
@pytest.mark.parametrize("size", [1, 1 << 23, 1 << 30])
def test_every_choice_of_masks_connects_what_is_close(spark, crowd, size):
    prints = near_prints(crowd + size, 150)
    fps = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    found = simhash.links(fps, 4, crowd, simhash.masks(size, 4)).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4 for r in found)
    if crowd == 512:
        assert len(found) == len({(r.a, r.b) for r in found}) == sum((x ^ y).bit_count() <= 4 for i, x in enumerate(prints) for y in prints[:i])
    links = spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")
    root = {r.node: r.root for r in components(links).collect()}
    mine = [root.get(simhash._signed(x), simhash._signed(x)) for x in prints]
    theirs = plain_components(list(range(len(prints))), prints)
    assert len(set(zip(mine, theirs, strict=True))) == len(set(mine)) == len(set(theirs))


def test_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_hubs_join_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    links = [(1000, 1000 + i) for i in range(1, 300)] + [(3000, 3000 - i) for i in range(1, 300)] + [(1, 2), (2, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3)}, **{1000 + i: 1000 for i in range(300)}, **{3000 - i: 2701 for i in range(300)}}


def test_one_of_each_keeps_one_row_of_a_group(docs, corpus):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    parts = plain_components([r[0] if r[0] is not None else 10**9 for r in corpus], [plain_fingerprint(t) for _, t, *_ in corpus])
    assert sorted(10**9 if i is None else i for i in ids) == sorted(set(parts))


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        got = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_few_links_take_no_rounds_and_give_the_same(spark, monkeypatch):
    from tidemark.llm import components as module

    r = random.Random(8)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (-7, 3)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(250)]
    rows = spark.createDataFrame(links, "a long, b long").repartition(7)
    few, jobs = jobs_of(spark, "few links", lambda: sorted(map(tuple, components(rows).collect())))
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    many, more = jobs_of(spark, "many links", lambda: sorted(map(tuple, components(rows).collect())))
    assert few == many and len(few) == len({node for node, _ in few}) and jobs <= 12 < more


def test_no_links_have_no_components(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0

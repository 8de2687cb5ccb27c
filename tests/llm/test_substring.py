from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import shared, substring
from tidemark.llm.fm_index import FMIndex, repeated_windows


def plain(rows, width):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {p for s in range(len(w) - width + 1) if seen[tuple(w[s : s + width])] > 1 for p in range(s, s + width)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "run", "crowd"), [(35, 8, 5000), (12, 4, 5000), (12, 4, 1), (5, 1, 2), (5, 5, 5000)])
def test_matches_brute_force(docs, corpus, width, run, crowd):
    got = substring.without_repeats(docs, width=width, run=run, crowd=crowd, shard_words=500).collect()
    assert sorted(map(tuple, got), key=str) == plain([r[:2] for r in corpus], width)


def morse(n):
    """Thue-Morse words and their complements: equal under any polynomial hash modulo 2^64 from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("crowd", [5000, 1])
def test_words_that_weak_hashes_confuse(spark, crowd):
    one, two = morse(2048)
    words = [f"w{i}" for i in range(41)]
    rows = [(i, " ".join([*words[:20], x, *words[21:]])) for i, x in enumerate((one, two))]
    got = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
    assert [r.n_removed for r in got] == [0, 0] and sorted(map(tuple, got)) == plain(rows, 35)


@pytest.mark.parametrize("carried", [substring.CARRIED, 1])
def test_crowded_passage(spark, monkeypatch, carried):
    """A passage in many documents, between words that some of them share: every level of the split is needed, with words
    that come along or, where no anchor is frequent enough, out of the texts."""
    monkeypatch.setattr(substring, "CARRIED", carried)
    r = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([*[f"{r.choice('ab')}{k}" for k in range(6)], *passage[r.randint(0, 9) :], *[f"{r.choice('cd')}{k}" for k in range(6)]])) for i in range(300)]
    got = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=3).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 35)


@pytest.mark.parametrize(("crowd", "broadcast"), [(1000, shared.BROADCAST_ROWS), (3, shared.BROADCAST_ROWS), (3, 0)])
def test_hot_anchors_and_segments_join_in_parts(spark, monkeypatch, crowd, broadcast):
    """Many copies of one text, a line that many texts hold, and others: every key of two rows counts as hot.  Crowded
    anchors are told to the segments by a broadcast or, where there are too many, by a join in parts."""
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(substring, "BROADCAST_ROWS", broadcast)
    r = random.Random(8)
    line = " ".join(f"l{i}" for i in range(40))
    own = lambda n: " ".join(f"{r.choice('abcde')}{r.randrange(9)}" for _ in range(n))
    copied = own(60)
    rows = [(i, copied) for i in range(90)] + [(100 + i, f"{own(8)} {line} {own(5)} {line}") for i in range(60)] + [(200 + i, own(50)) for i in range(9)]
    got = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 35)


def test_join_in_parts_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(3000)], "k long, v long")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(1, 6)] + [(0, "hot"), (0, "too")], "k long, name string")
    hot = shared.hot_keys(left.groupBy("k").count(), ["k"], "count", 3000, hot_share=3)
    assert [r.k for r in hot.collect()] == [0] and hot.first()["_parts"] == 2
    got = shared.join_spread(left, right, ["k"], hot, ["v"])
    assert got.columns == ["k", "v", "name"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_kept_text_and_empty(docs, no_docs):
    got = substring.without_repeats(docs, keep_text=True).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring.without_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_index_counts_and_windows(seed):
    r = random.Random(seed)
    kinds = r.choice([1, 2, 5, 60])
    segments = [[r.randrange(kinds) for _ in range(r.randint(1, 40))] for _ in range(r.randint(1, 12))]
    segments += [s[: r.randint(1, len(s))] for s in segments[:3]]
    words, ends = np.array(sum(segments, [])), np.cumsum([len(s) for s in segments])
    index = FMIndex(words, ends, kinds)
    for _ in range(40):
        s = r.choice(segments)
        a = r.randrange(len(s))
        pattern = s[a : a + r.randint(1, 8)]
        low, high = np.array([0]), np.array([index.size])
        for w in reversed(pattern):
            low, high = index.extend(np.array([w]), low, high)
        assert high[0] - low[0] == sum(x[i : i + len(pattern)] == pattern for x in segments for i in range(len(x) - len(pattern) + 1))
    for width in (1, 3, 7):
        seen = Counter(tuple(x[i : i + width]) for x in segments for i in range(len(x) - width + 1))
        want = [i + width <= len(x) and seen[tuple(x[i : i + width])] > 1 for x in segments for i in range(len(x))]
        assert repeated_windows(index, words, ends - [len(s) for s in segments], ends, width).tolist() == want


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 80).astype(np.uint64)
    one, two = np.concatenate((r.integers(0, 2**63, 31).astype(np.uint64), base)), np.concatenate((base, r.integers(0, 2**63, 17).astype(np.uint64)))
    found = []
    for h, shift in ((one, 31), (two, 0)):
        a, first, last, _ = substring.anchors(h, 35, 8)
        assert first[0] == 0 and last[-1] == h.size - 35 and (first[1:] == last[:-1] + 1).all()
        found.append({w - shift: x for x, f, g in zip(a.tolist(), first, last, strict=True) for w in range(f, g + 1)})
    assert all(found[0][w] == found[1][w] for w in range(80 - 35 + 1))

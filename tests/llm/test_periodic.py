from __future__ import annotations

import random

import pytest

from tidemark.llm import periodic


def plain_runs(w):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i >= q:
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return {(s, n, q) for (s, n), q in found.items()}


@pytest.mark.parametrize("seed", range(8))
def test_all_runs_of_random_and_periodic_words(seed):
    r = random.Random(seed)
    for _ in range(250):
        w = [r.randrange(r.choice([1, 2, 3, 5, 20])) for _ in range(r.randint(0, 50))]
        if len(w) > 4 and r.random() < 0.5:
            p, a = r.randint(1, len(w) // 2), r.randrange(len(w))
            w[a:] = [w[a + (i - a) % p] for i in range(a, len(w))]
        want = plain_runs(w)
        assert periodic.runs_of(w) == want
        for least in (2, 12):
            assert periodic.find_runs([b"w%d" % x for x in w], least) == sorted((x for x in want if x[1] >= least), key=lambda x: (x[0], x[2]))


def families(n):
    one, two = [0], [0, 1]
    while len(two) < n:
        one, two = two, two + one
    r = random.Random(2)
    block = [r.randrange(50) for _ in range(int(n**0.5))]
    yield [0] * n
    yield two[:n]
    yield [0, 1] * (n // 4) + [2] + [0, 1] * (n // 4 - 1) + [0, 0]
    yield [(i & -i).bit_length() for i in range(1, n)]
    yield [30 - (i & -i).bit_length() for i in range(1, n)]
    yield [bin(i).count("1") & 1 for i in range(n)]
    yield (block * n)[:n]
    yield sum(([0] * i + [1] for i in range(int((2 * n) ** 0.5))), [])


class Counted(list):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


@pytest.mark.parametrize("which", range(8))
def test_comparisons_stay_in_proportion(which):
    """Words read a word do not grow with the length, whatever repeats in it."""
    per = []
    for n in (2_000, 16_000):
        w = list(families(n))[which]
        Counted.reads = 0
        periodic.lyndon_edges(Counted([*w, -1]))
        per.append(Counted.reads / len(w))
    assert per[1] < 16 and per[1] < 1.3 * per[0] + 1


def test_operator(spark, docs, corpus, no_docs):
    got = sorted(map(tuple, periodic.collapse(docs).collect()), key=str)
    want = []
    for i, text, *_ in corpus:
        words = (text or "").encode().split()
        runs = sorted((x for x in plain_runs(words) if x[1] >= 12), key=lambda x: (x[0], x[2])) if len(words) < 1000 else periodic.find_runs(words, 12)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, b" ".join(x for k, x in enumerate(words) if k not in gone).decode()))
    assert [(a, b, [tuple(x) for x in c], d) for a, b, c, d in got] == sorted(want, key=str)
    assert any(r[2] for r in want) and periodic.collapse(no_docs).count() == 0


def test_planted_periods(spark):
    """The query's rewriting, against the rule word by word."""
    import zlib

    from tidemark.llm.queries import with_periods

    r = random.Random(1)
    rows = [(i, " ".join(str(r.randrange(400)) for _ in range(r.randint(0, 90)))) for i in range(400)] + [(None, "a b"), (12, None)]
    got = {(a, b) for a, b in with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, text in rows:
        w, h = (text or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        want.add((i, text))
    assert got == want

from __future__ import annotations

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def sample(n=400):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 80))]
        good = r.random() < 0.8
        rows.append((i, " ".join(words) + "." if good else " ".join(w + r.choice(["###", "%%", "$$"]) for w in words)))
        labels.append((i, int(good)))
    return rows, labels


KIND = "doc_id long, quality int"
#: Labels without an id, without a mark, and without a document.
MORE = [(None, 1), (2, None), (99999, 1)]


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, labels, quality.fit(docs, spark.createDataFrame(labels + MORE + [(1, labels[1][1])], KIND), per_class=150)


def test_held_out_accuracy(learned):
    docs, labels, ranking = learned
    got = {r.doc_id: r for r in quality.score(docs, ranking, ["doc_id"]).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and sum(got[i].predicted == y for i, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_learns_from_no_held_out_label(spark, learned):
    docs, labels, ranking = learned
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    again = quality.fit(docs, spark.createDataFrame(flipped + MORE, KIND), per_class=150)
    assert again.weights == pytest.approx(ranking.weights, abs=1e-6)


def test_fold_is_the_crc(spark):
    got = spark.range(50).withColumn("h", quality.held_out("id")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_odd_texts_and_empty_tables(docs, no_docs, learned, spark):
    got = quality.score(docs, learned[2], ["doc_id", "text"])
    assert got.count() == docs.count() and got.where(F.col("score").isNull() | F.isnan("score")).count() == 0
    assert quality.score(no_docs, learned[2], ["doc_id"]).count() == 0
    nothing = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, nothing, ["doc_id"]).collect()} == {0.3}


def test_features_ignore_nothing_of_a_long_text():
    clean = "word " * 50_000
    assert quality.features(clean) != quality.features(clean + "### " * 50_000)
    assert len(quality.features("")) == len(quality.features("a")) == len(quality.features(" \n")) == len(quality.FEATURES)


#: White space to Python's str, but words to the features, which know ASCII blanks alone.
WIDE_BLANKS = ["\u00a0", "\u3000", "\u0085", "\x1c", "\x1f", "\u2028\u2029", "\u00a0 \u3000\n\x1f"]


@pytest.mark.parametrize("text", WIDE_BLANKS)
def test_other_white_space_has_features(text):
    x = quality.features(text)
    assert len(x) == len(quality.FEATURES) and all(math.isfinite(v) for v in x)


def test_other_white_space_is_scored(spark, learned):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(WIDE_BLANKS)], "doc_id long, text string")
    assert quality.score(rows, learned[2], ["doc_id"]).where(F.col("score").between(0, 1)).count() == len(WIDE_BLANKS)


def test_words_and_lines_part_at_ascii_blanks():
    at = {n: i for i, n in enumerate(quality.FEATURES)}
    x = quality.features("a\u00a0b a\u00a0b\n\u3000\n\u3000\nc")
    assert x[at["log_words"]] == pytest.approx(math.log1p(5))
    assert x[at["repeated_words"]] == pytest.approx(1 - 3 / 5) and x[at["repeated_lines"]] == pytest.approx(1 - 3 / 4)


def test_weights_are_those_of_plain_gradient_descent():
    r = quality.np.random.default_rng(4)
    pairs = r.normal(size=(300, 5)) + quality.np.array([1.0, -0.5, 0.2, 0.0, 0.0])
    w = quality.np.zeros(5)
    for _ in range(20_000):
        p = 1 / (1 + quality.np.exp(pairs @ w))
        w = w - 0.1 * (0.01 * w - pairs.T @ p / len(pairs))
    assert quality.bradley_terry(pairs, 0.01) == pytest.approx(w, abs=1e-6)


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    rows, labels = sample(200)
    rows += [(i, t + f" other text {i}") for i, t in rows[:60]]
    marks = spark.createDataFrame(labels, KIND)
    one = quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), marks, per_class=60)
    two = quality.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1), marks, per_class=60)
    assert one == two


def test_every_label_counts(spark):
    """Over 2000 documents of each class: one bad kind of which no hash picks many, and its label moves the ranking."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(9000):
        good = i % 2
        rows.append((i, " ".join(r.choice(["tide", "mark", "river", "stone"]) + ("" if good or r.random() < 0.5 else "#") for _ in range(r.randint(3, 9)))))
        labels.append((i, good))
    docs, learn = spark.createDataFrame(rows, "doc_id long, text string"), [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5]
    by_hash = [x.id for x in spark.createDataFrame([(i,) for i in learn], "id long").orderBy(F.xxhash64("id")).collect()]
    late = {i for i in by_hash[-300:]}
    whole = quality.fit(docs, spark.createDataFrame(labels, KIND))
    other = quality.fit(docs, spark.createDataFrame([(i, 1 - y if i in late else y) for i, y in labels], KIND))
    assert max(abs(a - b) for a, b in zip(whole.weights, other.weights)) > 0.01


def test_blocks_give_the_weights_of_one_descent_and_the_best_cut(spark, monkeypatch):
    rows, labels = sample(300)
    monkeypatch.setattr(quality, "BLOCK", 1000)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, KIND)
    got = quality.fit(docs, marks)
    known = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    hashed = {x.id: x.h for x in spark.createDataFrame(known, "id long, y int").withColumn("h", F.xxhash64("id")).collect()}
    known.sort(key=lambda k: hashed[k[0]])
    texts = dict(rows)
    x, y = quality.np.array([quality.features(texts[i]) for i, _ in known]), quality.np.array([y for _, y in known])
    spread = quality.np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    weights = quality.bradley_terry(quality.np.concatenate(list(quality._pairs(x / spread, y, 8))), 0.01) / spread
    assert got.weights == pytest.approx(weights, rel=1e-6, abs=1e-9)
    s = x @ quality.np.array(got.weights)
    best = max((s[y == 1] >= c).mean() + (s[y == 0] < c).mean() for c in s)
    at = math.log(0.3 / 0.7) - got.bias
    assert (s[y == 1] >= at).mean() + (s[y == 0] < at).mean() == pytest.approx(best)


def test_a_rare_class_meets_every_block(spark, monkeypatch):
    rows, labels = sample(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bad = [k for k in labels if not k[1] and zlib.crc32(str(k[0]).encode()) % 5][:3]
    marks = spark.createDataFrame([k for k in labels if k[1]] + bad, KIND)
    monkeypatch.setattr(quality, "BLOCK", 16)
    small = quality.fit(docs, marks)
    again = quality.fit(docs.repartition(5), marks.repartition(3))
    got = {r.doc_id: r.predicted for r in quality.score(docs, small, ["doc_id"]).collect()}
    assert small == again and sum(got[i] == y for i, y in labels) / len(labels) > 0.97


def test_many_labels_meet_the_features(spark, monkeypatch):
    rows, labels = sample(200)
    rows += [(i, t + " again") for i, t in rows[:20]] + [(None, "no key")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + MORE, KIND)
    few = quality.fit(docs, marks)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    assert quality.fit(docs, marks) == few


@pytest.mark.parametrize("seed", range(3))
def test_best_cut_is_that_of_all_scores(spark, seed):
    r = random.Random(seed)
    rows = [(float(r.randint(0, 40)), r.randint(0, 1)) for _ in range(200)]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    gain = lambda c: sum(s >= c for s in good) * len(bad) + sum(s < c for s in bad) * len(good)
    at = quality._best_cut(spark.createDataFrame(rows, "s double, y int").repartition(4), 3, len(good), len(bad))
    assert gain(at) == max(gain(c) for c, _ in rows)

"""Quality scores from preference pairs by Bradley-Terry ranking (operator 7).

A labelled good document is preferred to a labelled bad one.  The model is logistic in the difference of their
features, so a document has a score of its own; documents pass if it reaches a quantile of the labelled scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.llm.shared import BROADCAST_ROWS, cut

#: Classes of bytes whose shares are features; a letter of another script counts as "other".
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "bar", "symbol", "quote", "control", "other")
_OF = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _bytes in (
    ("control", bytes(range(32)) + b"\x7f"),
    ("symbol", bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))),
    ("lower", bytes(range(97, 123))),
    ("upper", bytes(range(65, 91))),
    ("digit", bytes(range(48, 58))),
    ("space", b" \t\r"),
    ("newline", b"\n"),
    ("stop", b".,;:!?"),
    ("bar", b"|"),
    ("quote", b"\"'()-"),
):
    _OF[np.frombuffer(_bytes, np.uint8)] = CLASSES.index(_name)

FEATURES = (*[f"share_{c}" for c in CLASSES], "log_words", "word_bytes", "line_words", "line_spread", "repeated_lines", "repeated_words", "symbol_words", "long_words", "one_letter_words", "log_run")


def features(text: str) -> list[float]:
    """The features of one whole text; zeros for an empty one."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    if not raw.size:
        return [0.0] * len(FEATURES)
    of = _OF[raw]
    shares = np.bincount(of, minlength=len(CLASSES)) / raw.size
    blank = np.isin(raw, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    n = begin.size
    if not n:
        return [*shares.tolist(), *[0.0] * (len(FEATURES) - len(CLASSES))]
    size = end - begin
    odd = np.concatenate(([0], np.cumsum(np.isin(of, [CLASSES.index("symbol"), CLASSES.index("bar"), CLASSES.index("digit")]))))
    # Bytes are split at the blanks counted above, so there is a line and a word wherever n is not 0.
    lines = [x for x in data.split(b"\n") if x.strip()]
    widths = np.array([x.count(b" ") + 1 for x in lines])
    words = data.split()
    run = np.diff(np.concatenate(([-1], np.flatnonzero(np.diff(raw)), [raw.size - 1]))).max()
    more = (
        np.log1p(n),
        size.mean() / 10,
        np.log1p(widths.mean()),
        widths.std() / (1 + widths.mean()),
        1 - len(set(lines)) / len(lines),
        1 - len(set(words)) / len(words),
        (odd[end] > odd[begin]).mean(),
        (size > 12).mean(),
        (size == 1).mean(),
        np.log1p(run),
    )
    return [*shares.tolist(), *map(float, more)]


def with_features(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and ``x``, the features of each whole text (null: empty)."""
    kinds = StructType([StructField(c, docs.schema[c].dataType) for c in keep]).add("x", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, kinds)


@dataclass(frozen=True)
class Ranking:
    """A document's score is the logistic of ``bias`` plus the features weighed."""

    weights: tuple[float, ...]
    bias: float
    accept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -50, 50))), 6)


def held_out(key: str, folds: int = 5) -> Column:
    """Rows whose label is never learned: crc32 of the key as text divides by ``folds``."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)) == 0


def _slope(pairs: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over pairs (the preferred's features less the other's): the gradient and the Hessian of the logistic loss."""
    p = 1 / (1 + np.exp(np.clip(pairs @ w, -50, 50)))
    return -(pairs.T @ p), (pairs * (p * (1 - p))[:, None]).T @ pairs


def _newton(slope: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, n: int, reg: float, steps: int) -> np.ndarray:
    """Weights that minimize the mean loss of ``n`` pairs, whose sums ``slope`` gives, with an L2 term."""
    w = np.zeros(size)
    for _ in range(steps):
        g, h = slope(w)
        move = np.linalg.solve(h / n + reg * np.eye(size), reg * w + g / n)
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return w


def bradley_terry(pairs: np.ndarray, reg: float, steps: int = 50) -> np.ndarray:
    """Weights by Newton steps on the mean logistic loss of the preferred's features less the other's, with an L2 term."""
    return _newton(lambda w: _slope(pairs, w), pairs.shape[1], len(pairs), reg, steps)


def _block(table: pa.Table) -> pa.Table:
    """One row for a block: the features and marks of its documents in one order, and which of them are at home here."""
    table = table.sort_by([("h", "ascending"), ("id", "ascending")])
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    y, home = (table.column(c).to_numpy().astype(np.int8) for c in ("y", "home"))
    return pa.table({"block": table.column("block").slice(0, 1), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("x", x), ("y", y), ("home", home))}})


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in batch.to_pylist():
            y, home = np.frombuffer(r["y"], np.int8), np.frombuffer(r["home"], np.int8) == 1
            yield r["block"], np.frombuffer(r["x"]).reshape(-1, len(FEATURES)), y, home


def _sums(blocks: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[list[np.ndarray]]:
    """What ``of`` makes of each block, a few numbers, in the order of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x, y, home in _opened(batches):
            parts = [np.asarray(v, float).ravel().tolist() for v in of(x, y, home)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([parts], pa.list_(pa.list_(pa.float64())))], ["block", "parts"])

    found = blocks.mapInArrow(run, "block int, parts array<array<double>>").collect()
    return [[np.array(v) for v in r.parts] for r in sorted(found, key=lambda r: r.block)]


def _pairs(x: np.ndarray, y: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """``each`` times, a pair for every document of a block: good ones' features less bad ones'."""
    good, bad = x[y == 1], x[y == 0]
    if len(good) and len(bad):
        i, step = np.arange(max(len(good), len(bad))), max(1, len(good) // each)
        for k in range(each):
            yield good[(i + k * step) % len(good)] - bad[i % len(bad)]


def _best_cut(scores: DataFrame, parts: int, n_good: int, n_bad: int) -> float:
    """Where the scores (s, y) part the classes best, by the sum of both classes' shares on their own side: midway between
    the least score accepted and the greatest below it.  Of equal cuts the lowest."""
    by = scores.groupBy("s").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    # By number, so that a range of scores stays one partition; its sums then give the counts below each score.
    by = cut(by.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()))
    rows, good, bad, last = [], 0, 0, None
    for r in by.groupBy("part").agg(F.min("s").alias("s"), F.max("s").alias("last"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("s").collect():
        rows.append((r.part, good, bad, last))
        good, bad, last = good + r.good, bad + r.bad, r.last
    before = by.sparkSession.createDataFrame(rows, "part int, good_before long, bad_before long, last double")
    of = W.partitionBy("part").orderBy("s")
    upto = of.rowsBetween(W.unboundedPreceding, W.currentRow)
    below = [F.col(f"{c}_before") + F.sum(c).over(upto) - F.col(c) for c in ("good", "bad")]
    gain = below[1] * n_good + (F.lit(n_good) - below[0]) * n_bad
    cuts = by.join(F.broadcast(before), "part").select("s", gain.alias("gain"), F.coalesce(F.lag("s").over(of), "last", "s").alias("under"))
    best = cuts.agg(F.max(F.struct("gain", (-F.col("s")).alias("low"), "under")).alias("best")).first().best
    return (best.under - best.low) / 2


#: Labelled documents of the larger class go by blocks of about so many, which meet at least ``MEET`` of the smaller class.
BLOCK, MEET = 8192, 64


def _learnable(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, per_class: int | None) -> DataFrame:
    """_id, y, x: the labelled documents that may be learned from, one row an id."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("y"))
    usable = usable.groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("_z")).where("y = _z").drop("_z")
    if per_class is not None:
        picked = [usable.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
        usable = picked[0].unionByName(picked[1])
    own = docs.where(F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    # Texts stay where they are: few labels go to them, many meet the features instead.
    if usable.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = with_features(own.join(F.broadcast(usable), "_id"), ["_id", "_h", "y"], "_text")
    else:
        rows = with_features(own, ["_id", "_h"], "_text").join(usable, "_id")
    # Of several texts of one key the one of the least hash is used.
    return rows.groupBy("_id").agg(F.min("y").alias("y"), F.min(F.struct("_h", "x"))["x"].alias("x"))


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int | None = None, pairs_each: int = 8, accept: float = 0.3, reg: float = 0.01, text: str = "text", key: str = "doc_id", label: str = "quality"
) -> Ranking:
    """Learn weights from preference pairs, and the score quantile that parts the classes best.

    All labelled documents are used that :func:`held_out` leaves (with ``per_class``, so many of each class, those first
    by a hash of their key); of several texts of one key the one of the least hash, so the order and the partitions of
    the rows don't matter.  They are dealt to blocks by a hash of their key, where each is in ``pairs_each`` pairs or
    more; the smaller class goes to several blocks if it is rare.  Tasks keep the blocks' features and sum each Newton
    step's gradient and Hessian, so the driver gets a few hundred numbers a block; the cut is the best of all scores'.
    Rows with a null key or label are not used.  If a class is missing, nothing is learned and every document scores
    ``accept``.
    """
    rows = cut(_learnable(docs, labels, text, key, label, per_class))
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    logit = float(np.log(accept / (1 - accept)))
    if len(n) < 2:
        return Ranking((0.0,) * len(FEATURES), logit, accept)
    rare, parts = min(n, key=lambda y: (n[y], y)), -(-max(n.values()) // BLOCK)
    copies = min(parts, -(-MEET * parts // n[rare]))
    dealt = rows.withColumn("h", F.xxhash64("_id")).withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("y") == rare, copies - 1).otherwise(0))))
    dealt = dealt.select(F.pmod(F.pmod("h", F.lit(parts)) + F.col("i"), F.lit(parts)).cast("int").alias("block"), "h", F.col("_id").cast("string").alias("id"), "y", (F.col("i") == 0).cast("int").alias("home"), "x")
    blocks = cut(dealt.groupBy("block").applyInArrow(lambda table: _block(table), "block int, x binary, y binary, home binary"))

    size, total = len(FEATURES), sum(n.values())
    mean = sum(s for (s,) in _sums(blocks, lambda x, y, home: [x[home].sum(0)])) / total
    counted = _sums(blocks, lambda x, y, home: [((x[home] - mean) ** 2).sum(0), [sum(map(len, _pairs(x, y, pairs_each)))]])
    spread = np.sqrt(sum(v for v, _ in counted) / total)
    spread = np.where(spread > 1e-12, spread, 1.0)

    def slope(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(x, y, home):
            g, h = np.zeros(size), np.zeros((size, size))
            for pairs in _pairs(x / spread, y, pairs_each):
                more = _slope(pairs, w)
                g, h = g + more[0], h + more[1]
            return [g, h]

        found = _sums(blocks, of)
        return sum(g for g, _ in found), sum(h for _, h in found).reshape(size, size)

    # Digits past the tenth are the machine's.
    short = lambda v: float(f"{v:.10g}")
    weights = np.array([short(v) for v in _newton(slope, size, int(sum(c[0] for _, c in counted)), reg, 50) / spread])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y, home in _opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.round(x[home] @ weights, 9)), pa.array(y[home].astype(np.int32))], ["s", "y"])

    at = short(_best_cut(blocks.mapInArrow(scored, "s double, y int"), parts, n[1], n[0]))
    return Ranking(tuple(weights.tolist()), logit - at, accept)


def score(docs: DataFrame, ranking: Ranking, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, score, predicted: every whole text's score; the text stays where it is, no row moves.

    Null and empty texts have features of zero; repeated rows get equal scores; an empty table gives no rows.  ``keep``
    names what comes along; to carry columns called score or predicted, keep a struct of them.
    """
    kinds = StructType([StructField(c, docs.schema[c].dataType) for c in keep]).add("score", "double")
    read = keep if text in keep else [*keep, text]
    at = read.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(ranking.score(x))], [*keep, "score"])

    out = docs.select(*read).mapInArrow(run, kinds)
    return out.withColumn("predicted", (F.col("score") >= ranking.accept).cast("int"))

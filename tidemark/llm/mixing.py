"""Mixing sources to target weights with nested hash thresholds (operator 2).

A document's place in its source's order is a 60-bit hash, so that "the first so many words" is a filter on the
hash.  The threshold comes from histograms: words by source and by the hash's top bits, then the same inside the one
bucket in which the budget runs out, and so on.  Nothing is sorted, and what moves is one row a source and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, cut

HASH_BITS = 60


def place(*parts: str) -> Column:
    """A document's 60-bit place: the first 15 hex digits of the MD5 of its joined columns."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(source, source_size) to (sid, source, source_size, n, target, goal): one row a source.

    All sizes are shared by weight; no target exceeds ``max_repeats`` times its source, and the excess is shared
    again by weight.  A source is full if, once every fuller one has stopped, its level of words a weight is reached.
    The windows run over one row a source: a corpus has sources by the thousand, and more than some millions are not
    provided for.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w.cast("long"))
    capped = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), "sid")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (
        capped.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("full", F.col("cap") * F.sum("w").over(onward) <= F.col("left") * F.col("w"))
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("rest").cast("double") * F.col("w") / F.col("open_w"))
    return filled.withColumn("target", target).withColumn("goal", F.round("target").cast("long")).select("sid", "source", "source_size", "n", "target", "goal")


def threshold(docs: DataFrame, budgets: DataFrame, bits: int, levels: int, small: bool) -> DataFrame:
    """(sid, h, size) and (sid, budget) to (sid, upto, used): all documents with ``h < upto`` together have ``used``
    words, no more than the budget, and the next place in the order would exceed it.

    After ``levels`` histograms of 2^bits buckets each, the place is known to ``bits * levels`` bits.
    """
    side = F.broadcast if small else (lambda x: x)
    bound = budgets.select("sid", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("used"))
    for level in range(1, levels + 1):
        shift = HASH_BITS - bits * level
        inside = docs.join(side(bound), "sid").where(F.shiftright("h", shift + bits) == F.col("prefix"))
        bucket = F.shiftright("h", shift).bitwiseAND((1 << bits) - 1)
        hist = inside.groupBy("sid", bucket.alias("b"), "budget", "used").agg(F.sum("size").alias("words"))
        upto = hist.withColumn("cum", F.col("used") + F.sum("words").over(W.partitionBy("sid").orderBy("b")))
        fits = F.col("cum") <= F.col("budget")
        found = upto.groupBy("sid").agg(
            F.coalesce(F.min(F.when(~fits, F.col("b"))), F.lit(1 << bits)).alias("b"), F.max(F.when(fits, F.col("cum"))).alias("cum")
        )
        bound = cut(
            bound.join(found, "sid", "left").select(
                "sid",
                "budget",
                (F.shiftleft("prefix", bits) + F.coalesce("b", F.lit(0 if level > 1 else 1 << bits))).alias("prefix"),
                F.greatest("used", F.coalesce("cum", F.lit(0))).alias("used"),
            )
        )
    return bound.select("sid", F.shiftleft("prefix", HASH_BITS - bits * levels).alias("upto"), "used")


def nearest(left: DataFrame, gap: str) -> DataFrame:
    """(sid, last): the place of one document more, of those left, that brings its source nearer to its budget.

    It is larger than the ``gap`` and smaller than twice the gap; the nearest to the gap is taken, then the first place.
    """
    near = left.where((F.col("size") > 0) & (F.col("size") < 2 * F.col(gap))).groupBy("sid", "h").agg(F.sum("size").alias("words"), F.first(gap).alias("gap"))
    off = F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), "h")
    return near.where(F.col("words") < 2 * F.col("gap")).groupBy("sid").agg(F.min(off)["h"].alias("last"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_repeats: int = 3,
    bits: int = 12,
    levels: int = 3,
    rounds: int = 3,
    broadcast_sources: int = 50_000,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often each document is taken, so that each source comes near its target of words.

    Returns ``key, source, size, source_size, target, copies, taken``, one row a document.  Every source is taken
    whole as often as its target allows, and once more up to a threshold of the hash.  What the threshold leaves open
    (less than the next document) is filled from documents that still fit, by further thresholds, each past the last:
    ``rounds`` in all.  At the end one document more is taken where that comes nearer than leaving it.

    Null text has size 0; a null source is a source of its own, after all others; documents of equal key
    (repeated rows) and size are taken or left together; an empty table gives no rows.  Reruns agree, as nothing depends on
    the order or the partitions of the rows.  Columns named in ``keep`` come along, read once more rather than moved;
    others are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    base = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), place(key).alias("h")))
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = cut(targets(sums, weights, max_repeats))
    small = goal.count() <= broadcast_sources
    side = F.broadcast if small else (lambda x: x)
    ids = side(goal.select("sid", F.col("source").alias("_s")))
    base = base.join(ids, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("goal") - F.col("whole") * F.col("source_size"))

    steps = [threshold(base, goal.select("sid", "budget"), bits, levels, small)]
    plan = goal.join(steps[0].select("sid", F.col("upto").alias("t0"), "used"), "sid").withColumn("r0", F.col("budget") - F.col("used")).drop("used")
    for k in range(1, rounds):
        open_docs = base.join(side(plan.select("sid", f"t{k - 1}", f"r{k - 1}")), "sid").where((F.col("h") >= F.col(f"t{k - 1}")) & (F.col("size") <= F.col(f"r{k - 1}")))
        step = threshold(open_docs.select("sid", "h", "size"), plan.select("sid", F.col(f"r{k - 1}").alias("budget")), bits, levels, small)
        plan = plan.join(step.select("sid", F.col("upto").alias(f"t{k}"), "used"), "sid").withColumn(f"r{k}", F.col(f"r{k - 1}") - F.col("used")).drop("used")
    plan = cut(plan)
    once = reduce(
        lambda a, b: a | b,
        [F.col("h") < F.col("t0"), *[(F.col("h") >= F.col(f"t{k - 1}")) & (F.col("h") < F.col(f"t{k}")) & (F.col("size") <= F.col(f"r{k - 1}")) for k in range(1, rounds)]],
    )
    plan = cut(plan.join(nearest(base.join(side(plan), "sid").where(~once), f"r{rounds - 1}"), "sid", "left"))
    once = once | F.coalesce(F.col("h") == F.col("last"), F.lit(False))

    names = {c: f"_keep_{i}" for i, c in enumerate(keep) if c not in (key, source)}
    if names:
        base = docs.select(F.col(key).alias("key"), F.col(source).alias("_of"), size.alias("size"), place(key).alias("h"), *[F.col(c).alias(n) for c, n in names.items()])
        base = base.join(ids, F.col("_of").eqNullSafe(F.col("_s"))).drop("_s", "_of")
    out = base.join(side(plan), "sid").withColumn("copies", F.col("whole") + once.cast("long"))
    more = [F.col(n).alias(c) for c, n in names.items()]
    return out.select(F.col("key").alias(key), F.col("source").alias(source), *more, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))

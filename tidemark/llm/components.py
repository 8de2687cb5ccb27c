"""Connected components of links that come as a DataFrame, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BROADCAST_ROWS, cut, join_hot


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to (node, root), by following them one after another."""
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(u), top(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([top(x) for x in some], kind)], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node that ``node`` reaches.  Nodes without links are absent.

    Large and small stars in turn: every node links its larger neighbours, then its smaller ones, to the least node
    that it knows, until nothing changes: at most about the square of the logarithm of a component's size in rounds, and
    no limit ends them earlier.  Each round moves one row a link, and is cut so that lineage stays short.
    Every step aggregates before it joins, and nodes with very many links join by broadcast of their one row, so a hub's
    links stay where they are.

    Links so few that they could go by broadcast are followed in one task instead: a round costs the driver a dozen
    jobs, whatever the number of links.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    ends, seen = 2 * now.count(), None
    if ends <= 2 * BROADCAST_ROWS:
        kind = now.schema["u"].dataType.simpleString()
        return cut(now.coalesce(1).mapInArrow(_followed, f"node {kind}, root {kind}"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("c"))
        large = join_hot(both, least, "u", "c", ends).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = join_hot(large, least, "u", "c", ends).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.*").where("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        ends, seen = 2 * state[0], state

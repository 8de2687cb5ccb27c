"""Integer names by sorting: equal keys get equal names, a larger key a larger one, and no two keys share one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, small_batches


def named(df: DataFrame, keys: list[str], ties: list[str], keep: list[str]) -> tuple[DataFrame, int]:
    """(the rows' columns ``keep`` and ``name``, how many names): the dense rank, from 1, of ``keys``.

    ``keys`` are numbers, texts or binary values and never null; ``ties`` tell rows of a key apart, so that a key with a
    third of all rows is dealt to many tasks like any other rows.  The rows are sorted once, by ranges; each task counts
    the different keys that it sees, and the counts are added up over the tasks, less one where a task begins with the
    key that the one before it ends with.  Only these counts, one a task, come to the driver.
    """
    spark, n_keys = df.sparkSession, len(keys)
    slim = df.select(*keys, *[c for c in keep if c not in keys], *[c for c in ties if c not in keep and c not in keys])
    dealt = slim.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys)
    dealt = dealt.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)])
    key_kind = ", ".join(f"key{i}: {dealt.schema[f'key{i}'].dataType.simpleString()}" for i in range(n_keys))
    edge_kind = f"struct<first: struct<{key_kind}>, last: struct<{key_kind}>, n: bigint>"
    kinds = ", ".join(f"kept{i} {dealt.schema[f'kept{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, first, last, schema = TaskContext.get().partitionId(), 0, None, None, None
        names = [*[f"kept{i}" for i in range(len(keep))], "part", "rank", "edge"]
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(i) for i in range(n_keys)]
            if schema is None:
                of_keys = pa.struct([(f"key{i}", c.type) for i, c in enumerate(cols)])
                schema = [*[batch.column(n_keys + i).type for i in range(len(keep))], pa.int32(), pa.int64(), pa.struct([("first", of_keys), ("last", of_keys), ("n", pa.int64())])]
            new = np.zeros(len(batch), bool)
            for c in cols:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            head = [c[0].as_py() for c in cols]
            new[0] = head != last
            first = head if first is None else first
            last = [c[-1].as_py() for c in cols]
            ranks = n + np.cumsum(new)
            n = int(ranks[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[n_keys:], pa.array(np.full(len(batch), part, np.int32)), pa.array(ranks), pa.nulls(len(batch), schema[-1])], names)
            del batch, cols
            pa.default_memory_pool().release_unused()
        if schema is not None:
            edge = {"first": {f"key{i}": x for i, x in enumerate(first)}, "last": {f"key{i}": x for i, x in enumerate(last)}, "n": n}
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in schema[: len(keep)]], pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([edge], schema[-1])], names)

    with small_batches(spark):
        ranked = cut(dealt.mapInArrow(rank, f"{kinds}, part int, rank long, edge {edge_kind}"))
    edges = ranked.where("edge IS NOT NULL").select("part", "edge.*")
    sizes = dict(sorted(tuple(r) for r in edges.select("part", "n").collect()))
    parts = list(sizes)
    shared = set()
    if len(parts) > 1:
        following = F.broadcast(spark.createDataFrame(list(zip(parts, parts[1:])), "part int, following int"))
        ends = edges.join(following, "part").select("following", "last")
        shared = {r[0] for r in ends.join(edges.select(F.col("part").alias("following"), "first"), "following").where("first = last").select("following").collect()}
    offsets, total = [], 0
    for p in parts:
        offsets.append((p, total - (p in shared)))
        total = offsets[-1][1] + sizes[p]
    to = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    rows = ranked.where("edge IS NULL").join(to, "part")
    return rows.select(*[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)], (F.col("rank") + F.col("offset")).alias("name")), total

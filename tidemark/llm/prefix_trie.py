"""The trie of conversation prefixes as preorder intervals (operator 12).

Turns get integer names in the order of their role and text, conversations are sorted by the sequence of their turns'
names, and what a conversation does not share with the one before it is new nodes: their ranks in this order are the
trie's preorder.  A node's subtree is then an interval of ranks: it ends at the largest rank at which one of its members
ends.  Leaves and savings of a subtree are differences of prefix sums at the interval's ends.  The sums are taken in
buckets of ranks and over the buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.naming import named
from tidemark.llm.shared import bounded, cut, join_hot

#: How many members' keys a row lists at most; a node with more has several rows.
LISTED = 50_000

_EDGE = pa.struct([("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("path", pa.list_(pa.int64())), ("n", pa.int64())])
_WALKED = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.int32(), _EDGE]
_NAMES = ["conv", "path", "sizes", "ends_at", "chunk", "members", "part", "edge"]
_WALKED_SQL = "conv long, path array<long>, sizes array<long>, ends_at long, chunk long, members string, part int, edge struct<first: array<long>, last: array<long>, path: array<long>, n: long>"


def _alike(a: list[int], b: list[int]) -> int:
    """How many names two sequences begin with in common."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, names, sizes) of a task to nodes.

    A conversation's path has, for each depth, the number of a node that this task makes (from 1), or minus the depth
    where the node is one of the task's first conversation, which the task before may have made.  Members that end at a
    node come together and in order, and are listed.  One row at the end tells how the task begins and ends.
    """
    part, made, chunks, first, last, path = TaskContext.get().partitionId(), 0, 0, None, None, []
    ended: list[str] = []
    out: list[tuple] = []

    def listed() -> tuple:
        return (None, None, None, path[-1] if path else 0, chunks, ",".join(ended), part, None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _WALKED)], _NAMES)

    for batch in batches:
        for conv, names, sizes in zip(*(batch.column(i) for i in range(3)), strict=True):
            conv, names = conv.as_py(), names.as_py()
            if ended and (names != last or len(ended) == LISTED):
                out.append(listed())
                ended, chunks = [], chunks + 1
            if first is None:
                first, path = names, [-d for d in range(1, len(names) + 1)]
            elif names != last:
                same = _alike(last, names)
                path = path[:same] + list(range(made + 1, made + 1 + len(names) - same))
                made += len(names) - same
            last = names
            ended.append(str(conv))
            out.append((conv, path, sizes.as_py(), None, None, None, part, None))
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
    if first is not None:
        out += [listed(), (None, None, None, None, None, None, part, {"first": first, "last": last, "path": path, "n": made})]
        yield batch_of(out)


def _joined_up(edges: list) -> tuple[list[tuple[int, int, list[int]]], int]:
    """(part, shift, ranks of its first conversation's nodes) of each task, and how many nodes there are with the root,
    whose rank is 0."""
    out, total, names, ranks = [], 1, [], []
    for part, e in edges:
        same = _alike(names, e["first"])
        begin = ranks[:same] + list(range(total, total + len(e["first"]) - same))
        shift = total + len(e["first"]) - same - 1
        out.append((part, shift, begin))
        total = shift + 1 + e["n"]
        names, ranks = e["last"], [shift + c if c > 0 else begin[-c - 1] for c in e["path"]]
    return out, total


def _rank(code: Column) -> Column:
    return F.when(code > 0, F.col("shift") + code).when(code < 0, F.element_at("begin", (-code).cast("int"))).otherwise(F.lit(0))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists in order to one digest a node, holding one list at a time."""
    at, state, out = None, None, []
    for batch in batches:
        for rank, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rank != at:
                if at is not None:
                    out.append((at, state.hexdigest()))
                at, state = rank, hashlib.sha256()
            else:
                state.update(b",")
            state.update(members.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["rank", "ends_sha256"])
            out = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["rank", "ends_sha256"])


def _running(nodes: DataFrame, total: int, **sums: Column) -> DataFrame:
    """Nodes with the sums over all ranks up to their own."""
    nodes = nodes.withColumn("bucket", F.floor(F.col("rank") / max(256, isqrt(total))))
    by_bucket = nodes.groupBy("bucket").agg(*[F.sum(x).alias(f"all_{c}") for c, x in sums.items()])
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(by_bucket.select("bucket", *[F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"from_{c}") for c in sums]))
    inside = Window.partitionBy("bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    added = nodes.select("*", *[F.sum(x).over(inside).alias(f"in_{c}") for c, x in sums.items()]).join(bounded(starts), "bucket")
    return added.select(*[c for c in nodes.columns if c != "bucket"], *[(F.col(f"from_{c}") + F.col(f"in_{c}")).alias(c) for c in sums])


def trie(turns: DataFrame, order: list[str], members: DataFrame | None = None, key: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a different beginning of conversations, from the empty one (depth 0, the root) on; turns are equal in role
    and text.  ``conv_id`` is the smallest member, ``n_leaves`` counts the childless nodes from here down, and
    ``saved_tokens`` the bytes of each node's last text for all members but one, summed from here down.  ``ends_sha256``
    is that of the keys, ascending and comma-joined, of the members that end here.

    Keys are whole numbers; rows of a null key belong to no conversation.  A null role or text counts as empty; nulls in
    ``order`` come first and ties are ordered by role and text, so repeated rows are turns of their own.  ``members``
    may name conversations that have no turns, which end at the root.  A conversation's turns are gathered as numbers, so
    long texts never meet in one row.  Without conversations there are no nodes.  Other columns are not read.
    """
    spark = turns.sparkSession
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    slim = turns.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("conv"), F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]).alias("at"), plain(role).alias("role"), plain(text).alias("text"))
    turn, _ = named(slim.withColumn("size", F.octet_length("text").cast("long")), ["role", "text"], ["conv", "at"], ["conv", "at", "size"])
    said = F.when(F.col("name").isNotNull(), F.struct("at", "name", "size"))
    if members is not None:
        silent = members.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("conv"))
        turn = turn.unionByName(silent, allowMissingColumns=True)
    whole = turn.groupBy("conv").agg(F.sort_array(F.collect_list(said)).alias("t")).select("conv", F.col("t.name").alias("names"), F.col("t.size").alias("sizes"))
    walked = cut(whole.repartitionByRange("names", "conv").sortWithinPartitions("names", "conv").select("conv", "names", "sizes").mapInArrow(_walk, _WALKED_SQL))
    # One row a task: two conversations as numbers.
    starts, total = _joined_up(sorted((r.part, r.edge.asDict()) for r in walked.where("edge IS NOT NULL").select("part", "edge").collect()))
    walked = walked.join(F.broadcast(spark.createDataFrame(starts, "part int, shift long, begin array<long>")), "part")

    steps = walked.where("conv IS NOT NULL").select("conv", F.concat(F.array(F.lit(0).cast("long")), F.transform("path", _rank)).alias("path"), F.concat(F.array(F.lit(0).cast("long")), F.col("sizes")).alias("sizes"))
    steps = steps.select("conv", F.element_at("path", -1).alias("last"), F.posexplode(F.arrays_zip("path", "sizes", F.concat(F.array(F.lit(None).cast("long")), F.col("path")).alias("up"))).alias("depth", "x"))
    nodes = steps.select("conv", "last", "depth", "x.*").where("path IS NOT NULL").groupBy(F.col("path").alias("rank")).agg(
        F.min("conv").alias("conv_id"), F.max(F.col("depth").cast("long")).alias("depth"), F.max("up").alias("parent"), F.max("sizes").alias("size"), F.count(F.lit(1)).alias("n_convs"), F.max("last").alias("last")
    )
    nodes = cut(nodes)
    summed = cut(_running(nodes, total, leaves=(F.col("last") == F.col("rank")).cast("long"), saved=(F.col("n_convs") - 1) * F.col("size")))
    ends = summed.select(F.col("rank").alias("last"), F.col("leaves").alias("end_leaves"), F.col("saved").alias("end_saved"))
    over = summed.join(ends, "last").select(
        "rank", "conv_id", "depth", "parent", "n_convs",
        (F.col("end_leaves") - F.col("leaves") + (F.col("last") == F.col("rank")).cast("long")).alias("n_leaves"),
        (F.col("end_saved") - F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("rank")).agg(F.count(F.lit(1)).alias("n_children"))
    lists = walked.where("members IS NOT NULL").select(_rank(F.col("ends_at")).alias("rank"), "part", "chunk", "members")
    digests = lists.repartition("rank").sortWithinPartitions("rank", "part", "chunk").select("rank", "members").mapInArrow(_streamed, "rank long, ends_sha256 string")
    full = cut(over.join(children, "rank", "left").join(digests, "rank", "left"))
    parents = full.where("n_children > 0").select(F.col("rank").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    placed = join_hot(full, parents, "parent", "siblings", total)
    return placed.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))

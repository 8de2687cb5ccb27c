"""Exact dedup by deterministic block naming (operator 13).

Texts are cut into blocks of a fixed number of bytes; sorting the blocks gives each an integer name, equal blocks the
same.  Then the names of adjacent blocks are paired and the pairs are named in the same way, until each text has one
name.  Two texts have the same name after the same number of rounds exactly if they are equal: no digest decides.
Texts move once, as blocks; every later round moves half as many rows of numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.naming import named
from tidemark.llm.shared import cut, join_hot

#: ASCII white space, which does not count.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of texts that a task holds as blocks at a time.
_HELD = 1 << 20


def _blocks(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(row, pos, n, about, block): the texts' blocks without blanks, ``n`` a text; its first tells what is known of it."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def block_batch(rows: pa.Array, keys: pa.Array, held: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
        lengths = np.array([len(x[0]) for x in held], np.int64)
        counts = np.maximum(1, -(-lengths // size))
        of = np.repeat(np.arange(len(held)), counts)
        pos = np.arange(of.size) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(lengths) - lengths)[of] + pos * size
        data = b"".join(x[0] for x in held)
        blocks = pa.BinaryArray.from_buffers(pa.binary(), of.size, [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32).tobytes()), pa.py_buffer(data)])
        begins = pa.array(np.where(pos == 0, of, -1), mask=pos != 0)
        about = pa.StructArray.from_arrays([keys.take(begins), pa.array([x[1] for x in held], pa.int64()).take(begins), pa.array([x[2] for x in held], pa.string()).take(begins)], ["key", "chars", "sha"], mask=pa.array(pos != 0))
        return pa.RecordBatch.from_arrays([rows.take(pa.array(of)), pa.array(pos), pa.array(counts[of]), about, blocks], ["row", "pos", "n", "about", "block"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, begin, load = [], 0, 0
            for i, t in enumerate(batch.column(2)):
                t = t.as_py()
                plain = t.encode().translate(None, BLANKS)
                held.append((plain, len(t), hashlib.sha256(plain).hexdigest()))
                load += len(plain)
                if load > _HELD or i == len(batch) - 1:
                    yield block_batch(batch.column(0)[begin : i + 1], batch.column(1)[begin : i + 1], held)
                    held, begin, load = [], i + 1, 0
            pa.default_memory_pool().release_unused()

    return slim.mapInArrow(cut_up, f"row long, pos long, n long, about struct<key: {kind}, chars: bigint, sha: string>, block binary")


def identities(docs: DataFrame, size: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, id, about): every row's identity, equal for equal texts and for no others; ``about`` has its key, its
    original code points and the SHA-256 of what counts of it."""
    now, _ = named(_blocks(docs, size, text, key), ["block"], ["row", "pos"], ["row", "pos", "n", "about"])
    done, level = [], 0
    while True:
        # Texts that end in different rounds have different numbers of blocks, so the round is part of the identity.
        done.append(now.where("n = 1").select("row", (F.lit(level << 56) + F.col("name")).alias("id"), "about"))
        more = now.where("n > 1")
        if more.isEmpty():
            return reduce(DataFrame.unionAll, done)
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = more.groupBy("row", F.floor(F.col("pos") / 2).alias("half")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(0)).alias("b"), F.max("n").alias("n"), F.max("about").alias("about"))
        pairs = pairs.select("row", F.col("half").alias("pos"), F.floor((F.col("n") + 1) / 2).alias("n"), "about", "a", "b")
        now, _ = named(pairs, ["a", "b"], ["row", "pos"], ["row", "pos", "n", "about"])
        level += 1


def _first(*order: Column) -> Column:
    return F.min(F.struct(*order))


def groups(docs: DataFrame, size: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row: of the rows whose texts are equal without ASCII white
    space, the one with the most code points stays, then that of the smallest key.

    A null text counts as empty, and empty texts are equal to each other.  Null keys come after all others; of rows with
    the same key and equal texts of one length exactly one stays.  Repeated rows are rows of their own.  Very long texts
    are more blocks and more rounds.  An empty table gives no rows.  Other columns are not read.  Rows are numbered by
    their place, so the input must read the same again when a task is retried, as files and checkpoints do.
    """
    rows = identities(docs, size, text, key)
    best = _first((-F.col("about.chars")).alias("less"), F.col("about.key").isNull().alias("none"), F.col("about.key").alias("key"), "row")
    several = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1"))
    held = join_hot(rows, several, "id", "group_size", rows.count())
    alone = F.col("group_size").isNull()
    return held.select(
        F.col("about.key").alias(key),
        F.when(alone, F.col("about.key")).otherwise(F.col("best.key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("about.sha").alias("text_sha256"),
    )

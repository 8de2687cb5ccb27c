"""What the operators share: word patterns, the shared folder, and joins that bear hot keys."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut, new_folder, shared_folder  # noqa: F401  the operators take them from here

#: A run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same as byte tables, for code that runs over UTF-8 bytes.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


#: Up to so many rows no task is large, whatever the keys.
FEW_ROWS = 20_000


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, hot_share: int = 1000) -> DataFrame:
    """``left`` join ``right`` (left outer) on ``key``, where ``right`` has one row a key and ``weight``, the key's
    number of rows in ``left``.

    Keys with more than ``total / hot_share`` rows go by broadcast: there can be no more than ``hot_share`` of them,
    as their weights sum to ``total`` at most.  All others are shuffled, and none of them is large.
    """
    if total <= FEW_ROWS:
        return left.join(right, key, "left")
    most = max(1, total // hot_share)
    hot = F.broadcast(right.where(F.col(weight) > most).withColumn("_hot", F.lit(True)))
    seen = left.join(hot.select(key, "_hot"), key, "left")
    calm = seen.where(F.col("_hot").isNull()).drop("_hot").join(right.where(F.col(weight) <= most), key, "left")
    busy = seen.where(F.col("_hot").isNotNull()).drop("_hot").join(hot.drop("_hot"), key)
    return calm.unionByName(busy)


def hot_keys(counts: DataFrame, on: list[str], weight: str, total: int, hot_share: int = 1000) -> DataFrame | None:
    """The keys of ``counts`` with more than ``total / hot_share`` rows, ``hot_share`` at most as their ``weight`` sums to
    ``total``, with ``_parts``, the parts that share their rows; None where no task could be large."""
    if total <= FEW_ROWS:
        return None
    most = max(1, total // hot_share)
    return counts.where(F.col(weight) > most).select(*on, F.ceil(F.col(weight) / most).cast("int").alias("_parts"))


def join_spread(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, by: list[str]) -> DataFrame:
    """``left`` join ``right`` on ``on``, where ``right`` has few rows a key.

    The left rows of ``hot`` keys (see :func:`hot_keys`) are dealt to parts by their values of ``by``, and the right rows
    of these keys go to every part.  Unlike :func:`join_hot` it reads the left side once, so what makes it runs once.
    """
    if hot is None:
        return left.join(right, on)
    hot, parts = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    held = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(held, [*on, "_part"]).drop("_part")


#: What a broadcast table may have: rows, of a few numbers each.
BROADCAST_ROWS = 200_000


#: Rows and bytes of a batch between Spark and Python where rows are long: each task holds several copies of one.
SMALL_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def small_batches(spark: SparkSession):
    """What is planned and run inside hands rows to Python in small batches."""
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCH}
    for k, v in SMALL_BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table as the small side of a join: broadcast if it has no more than ``most`` rows, shuffled otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_hash")


def unused(df: DataFrame, *names: str) -> str:
    """A column name that none of the table's is, whatever its letters' case."""
    have, name = {c.lower() for c in df.columns}, "_tm_" + "_".join(names)
    while name.lower() in have:
        name += "_"
    return name


def packed(docs: DataFrame, *plain: str) -> DataFrame:
    """``doc``, a struct of all columns, and those named, so that no other name can clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[F.col(f"`{c}`") for c in plain])


def fold(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def open_fs(uri: str):
    """A pyarrow file system and the path inside it, for archives that tasks write and read by offset."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)

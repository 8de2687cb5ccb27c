"""Near copies by the similarity of whole shingle sets: operator 1 widened from a few bits to a Jaccard similarity.

Candidates come from the deletion-variant index of :mod:`simhash`, which finds the closest texts, and from a prefix
filter, which finds all: two sets with a similarity of at least ``similarity`` share one of their first
``n - ceil(similarity * n) + 1`` shingles in any order that is the same for all sets.  Rare shingles come first.
SimHash fingerprints of 128 bits turn away most sets that meet by chance; what is left is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.shared import FOLD, bounded, cut, unused

SEED = 42
#: Shingles are counted in so many classes by their hash, in blocks of ``BLOCK``.  The counts only choose the order; every
#: order finds every pair.
CLASSES, BLOCK = 1 << 20, 1 << 14
#: What a product with the similarity may be off by.
EPS = 1e-9
#: Sets of 0.8 differ in 19.4 of 128 bits, give or take 4.1; others in 64, give or take 5.7.  Small sets are not asked.
BITS, SMALL = 44, 8
#: A task compares one set with no more than about so many others, and with so many shingles.
TOGETHER, SHINGLES = 256, 1 << 21


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``width`` words, or of all its words if they are fewer.

    Words are runs of other characters than ASCII white space, A-Z in lower case.
    """
    import xxhash

    words = text.encode().translate(FOLD).split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.array([len(w) for w in words])).tolist()
    ends = ends.tolist()
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])], np.uint64).view(np.int64))


def _majority(h: np.ndarray, slice_at: int = 1 << 16) -> int:
    """The SimHash of hashes: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, h.size, slice_at):
        ones += np.unpackbits(h[at : at + slice_at].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > h.size).tobytes(), "big", signed=True)


def _other(h: np.ndarray) -> np.ndarray:
    """A second hash of each."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _class(s: np.ndarray) -> np.ndarray:
    return s & (CLASSES - 1)


def _counts(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES, np.int32)
    for batch in batches:
        for t in batch.column(0):
            # A shingle's class comes up more than once in a set at times, so this counts and does not mark.
            c, n = np.unique(_class(shingle_set(t.as_py() or "", width)), return_counts=True)
            total[c] += n.astype(np.int32)
    blocks = total.reshape(-1, BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "n"])


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in table.column("n"):
        total += np.frombuffer(x.as_py(), np.int32)
    return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})


def _how_often(texts: DataFrame, width: int) -> np.ndarray:
    """The number of sets with a shingle of each class, over all texts: a table of fixed size, 4 MB."""
    often = np.zeros((CLASSES // BLOCK, BLOCK), np.int32)
    found = texts.mapInArrow(partial(_counts, width), "block long, n binary").groupBy("block").applyInArrow(lambda table: _added(table), "block long, n binary")
    for r in found.collect():
        often[r.block] = np.frombuffer(r.n, np.int32)
    return often.ravel()


def _sketches(width: int, similarity: float, often: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, sid (the set's hash), n (its size), f0 and f1 (its SimHashes), p (its prefix; null where the task has given it)."""
    import xxhash

    given: set = set()
    for batch in batches:
        for at in range(0, len(batch), 256):
            part, rows = batch.slice(at, 256), []
            for t in part.column(1):
                s = shingle_set(t.as_py() or "", width)
                sid = int(np.array(xxhash.xxh64_intdigest(s.tobytes(), SEED), np.uint64).view(np.int64))
                p = None
                if sid not in given:
                    given.add(sid)
                    upto = s.size - int(np.ceil(similarity * s.size - EPS)) + 1 if s.size else 0
                    p = s[np.lexsort((s, often[_class(s)]))[:upto]]
                h = s.view(np.uint64)
                rows.append((sid, s.size, _majority(h), _majority(_other(h)), p))
            sid, n, f0, f1, p = zip(*rows)
            columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (sid, n, f0, f1)), pa.array(p, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sid", "n", "f0", "f1", "p"])


def _alike(width: int, similarity: float, table: pa.Table) -> pa.Table:
    """(a, b): which of a group's sets are as similar to set ``b`` as asked."""
    b = table.column("b")[0].as_py()
    ids, texts = table.column("sid").to_pylist(), table.column("text")
    lead = shingle_set(texts[ids.index(b)].as_py() or "", width)
    hit = []
    for i, sid in enumerate(ids):
        if sid != b:
            s = shingle_set(texts[i].as_py() or "", width)
            shared = np.intersect1d(lead, s, assume_unique=True).size
            if shared >= similarity * (lead.size + s.size - shared) - EPS:
                hit.append(sid)
    return pa.table({"a": pa.array(hit, pa.int64()), "b": pa.array([b] * len(hit), pa.int64())})


def _near(l: str, r: str, similarity: float) -> Column:
    """May two sets be similar, by their sizes and fingerprints?"""
    n, m = F.col(f"{l}.n"), F.col(f"{r}.n")
    bits = sum((F.bit_count(F.col(f"{l}.{f}").bitwiseXOR(F.col(f"{r}.{f}"))) for f in ("f0", "f1")), F.lit(0))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - EPS) & ((bits <= BITS) | (F.least(n, m) < SMALL))


def _pairs(rest: DataFrame, similarity: float) -> DataFrame:
    """(a, b): sets that meet at a shingle, lie in different groups, and may be similar.

    If the first shingle that two sets share has places i and j, they share ``min(n - i, m - j)`` shingles at most.  So
    a set looks only for smaller ones, down to the similarity, and only up to what is left behind its place; sizes go by
    classes of a twentieth, which are part of the join's key.
    """
    share = similarity / (1 + similarity)
    size = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) / float(np.log(1.05))).cast("int")
    least, most = F.ceil(F.col("n") * similarity - EPS), F.least(F.col("n"), F.floor((F.col("n") - F.col("i")) / share - F.col("n") + EPS))
    asks = rest.withColumn("least", least).withColumn("most", most).where("most >= least")
    asks = asks.withColumn("of", F.explode(F.sequence(size(F.col("least")), size(F.col("most")))))
    met = (F.col("l.token") == F.col("r.token")) & (F.col("l.of") == F.col("r.of")) & (F.col("l.root") != F.col("r.root"))
    once = (F.col("l.n") > F.col("r.n")) | (F.col("l.sid") < F.col("r.sid"))
    new = (F.col("l.sid") != F.col("l.low")) & (F.col("r.sid") != F.col("l.low"))
    fits = F.col("r.n").between(F.col("l.least"), F.col("l.most"))
    left = F.least(F.col("l.n") - F.col("l.i"), F.col("r.n") - F.col("r.i")) >= share * (F.col("l.n") + F.col("r.n")) - EPS
    both = asks.alias("l").join(rest.withColumn("of", size(F.col("n"))).alias("r"), met & once & new & fits & left & _near("l", "r", similarity))
    return both.select(F.greatest("l.sid", "r.sid").alias("a"), F.least("l.sid", "r.sid").alias("b")).distinct()


def _verified(texts: DataFrame, heads: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar by their whole sets.

    A set ``b`` and those that it is compared with meet in as many groups as keep each small.
    """
    load = pairs.join(heads.select(F.col("sid").alias("a"), "n"), "a").groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    load = cut(load.select("b", F.greatest(F.ceil(F.col("c") / TOGETHER), F.ceil(F.col("n") / SHINGLES), F.lit(1)).cast("int").alias("k")))
    members = pairs.join(load, "b").select("b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("chunk"), F.col("a").alias("sid"))
    leads = load.select("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"), F.col("b").alias("sid"))
    needed = cut(members.unionByName(leads).join(heads.select("sid", F.col("least.h").alias("h")), "sid"))
    both = texts.select("h", "text").join(bounded(needed), "h").select("b", "chunk", "sid", "text")
    return both.groupBy("b", "chunk").applyInArrow(lambda table: _alike(width, similarity, table), "a long, b long")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows and columns of ``docs``, with one row of every group that links of at least ``similarity`` connect: that of
    the smallest key (nulls last), then of the smallest hash of its text; of rows alike in both one stays.

    Null, empty and blank texts have no shingles and count as copies of each other.  Equal sets meet before any pair is
    sought.  First each set is compared with the least of those that it meets, then sets that meet and are not yet
    connected are compared in pairs.  An empty table gives no rows; columns of any other name stay as they are.
    """
    h = F.xxhash64(F.col(key), F.col(text))
    texts = docs.select(h.alias("h"), F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), h.alias("h")).alias("key"), F.col(text).cast("string").alias("text"))
    often = _how_often(texts.select("text"), width)
    kind = texts.schema["key"].dataType.simpleString()
    own = cut(texts.select("key", "text").mapInArrow(partial(_sketches, width, similarity, often), f"key {kind}, sid long, n long, f0 long, f1 long, p array<bigint>"))
    heads = cut(own.groupBy("sid").agg(F.min("key").alias("least"), F.first("n").alias("n"), F.first("f0").alias("f0"), F.first("f1").alias("f1")))

    # The closest: fingerprints few bits apart, by deletion variants.
    print_of = heads.where("n > 0").groupBy(F.col("f0").alias("fp")).agg(F.min("sid").alias("one"))
    few = simhash.links(print_of.select("fp"), distance)
    a, b = print_of.select(F.col("fp").alias("a"), F.col("one").alias("x")), print_of.select(F.col("fp").alias("b"), F.col("one").alias("y"))
    close = few.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    close = close.unionByName(heads.join(print_of, heads["f0"] == print_of["fp"]).where("sid <> one").select(F.col("sid").alias("a"), F.col("one").alias("b")))
    # All others: sets that share a shingle of their prefixes, each with the least set of that shingle.
    of = W.partitionBy("token")
    met = own.where("p is not null").select(F.posexplode("p").alias("i", "token"), "sid").repartition("token").distinct()
    # The least set of a shingle is one with few rarer shingles: what others are edited copies of, where it is there.
    low = F.min(F.struct("i", "sid")).over(of)["sid"]
    met = cut(met.withColumn("c", F.count(F.lit(1)).over(of)).withColumn("low", low).where("c > 1").drop("c"))
    stars = close.unionByName(met.where("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b")))
    stars = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    slim = heads.select("sid", "n", "f0", "f1")
    near = stars.join(slim.alias("l"), F.col("a") == F.col("l.sid")).join(slim.alias("r"), F.col("b") == F.col("r.sid")).where(_near("l", "r", similarity))
    links = cut(_verified(texts, heads, cut(near.select("a", "b")), width, similarity))
    # What is connected needs no more; the rest of those that met is compared in pairs.
    root = components(links)
    placed = met.join(root, met["sid"] == root["node"], "left").select("token", "i", "sid", "low", F.coalesce("root", "sid").alias("root"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    rest = cut(placed.join(mixed, "token").join(slim, "sid"))
    pairs = cut(_pairs(rest, similarity))
    if not pairs.isEmpty():
        # What is known to be connected goes on as one link a set.
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(texts, heads, pairs, width, similarity)))

    named = heads.join(root, heads["sid"] == root["node"], "left").select(F.col("least"), F.coalesce("root", "sid").alias("root"))
    stay = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.h").alias("h"))
    seen = own.groupBy(F.col("key.h").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    fate = cut(seen.join(stay.select("h", F.lit(True).alias("stays")), "h", "left").where("stays is null or c > 1").select("h", F.col("stays").isNotNull().alias("stays")))
    name = unused(docs, "h")
    named_docs = docs.withColumn(name, F.xxhash64(F.col(key), F.col(text)))
    out = named_docs.join(bounded(fate.select(F.col("h").alias(name))), name, "left_anti").drop(name)
    again = fate.where("stays")
    if again.isEmpty():
        return out
    # Rows alike in key and text: one of them.
    return out.unionByName(named_docs.join(bounded(again.select(F.col("h").alias(name))), name, "left_semi").dropDuplicates([name]).drop(name))

"""SimHash near-duplicates by deletion-variant signatures (operator 1).

Fingerprints of 64 bits are linked at ``distance`` or fewer differing bits.  They are cut into so few segments that
some choice of segments differs by at most one bit; each choice is indexed once for every bit left out, so that
linked fingerprints share an indexed value, found by an equality join and verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import FOLD, bounded, cut, join_hot, unused

SEED = 42


def fingerprint(text: str, width: int = 4, slice_at: int = 1 << 16) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number; 0 without words.

    Words are runs of other characters than ASCII white space, A-Z in lower case.
    """
    import xxhash

    words = text.encode().translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.array([len(w) for w in words])).tolist()
    ends = ends.tolist()
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    n = len(words) - width + 1
    for at in range(0, n, slice_at):
        upto = min(n, at + slice_at)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:upto], ends[at + width - 1 : upto + width - 1])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp``: every whole text's fingerprint, of its shingles of ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py() or "", width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, fp long").select(F.col("key").alias(key), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(n: int, distance: int) -> list[int]:
    """Bit masks such that fingerprints within ``distance`` differ by at most one bit under one of them.

    One of three segments does for distance 4 and up to a few million fingerprints.  For more, ``take`` segments out
    of ``distance - 1 + take`` (of which at least ``take - 1`` must be equal and one more differs by a bit at most)
    give longer values, so that few fingerprints share one by chance.  Every choice finds every link.
    """
    if n <= 1 << 22:
        take, parts = 1, distance // 2 + 1
    else:
        take = 2 if n <= 1 << 26 else 3 if n <= 1 << 32 else 4
        parts = distance - 1 + take
    cuts = [64 * i // parts for i in range(parts + 1)]
    segments = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(segments, take)]


def variants(fps: DataFrame, chosen: list[int]) -> DataFrame:
    """(fp) to (tag, value, fp): the value under each mask with each of its bits left out in turn."""
    pairs = [(m, 1 << b) for m in chosen for b in range(64) if m >> b & 1]
    wild = F.array(*[F.lit(_signed(m & ~b)) for m, b in pairs])
    return fps.select("fp", F.posexplode(wild).alias("tag", "m")).select("tag", F.col("fp").bitwiseAND(F.col("m")).alias("value"), "fp")


def first_tag(x: Column, tag: Column, chosen: list[int]) -> Column:
    """Is this the first tag under which fingerprints that differ by ``x`` meet?  So each link comes once."""
    at, cases = 0, None
    for m in chosen:
        bits = [b for b in range(64) if m >> b & 1]
        d = x.bitwiseAND(F.lit(_signed(m)))
        # Equal under the mask: its first tag.  One bit apart: the tag that leaves that bit out, by its rank in the mask.
        below = F.bit_count((d - 1).bitwiseAND(F.lit(_signed(m))))
        where = F.when(d == 0, F.lit(at)).otherwise(F.lit(at) + below)
        hit = F.bit_count(d) <= 1
        cases = F.when(hit, where) if cases is None else cases.when(hit, where)
        at += len(bits)
    return tag == cases


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links among fingerprints of crowded values, without pairs: those within ``2 * radius`` bits share a point within
    ``radius`` of both, and all that lie about a point are linked, so each is linked to the least of them."""
    flips = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(64), k)]
    flip = F.array(*[F.lit(_signed(x)) for x in flips])
    points = fps.select("fp", F.explode(flip).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_hot(points, least, "point", "n", len(flips) * fps.count()).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def links(fps: DataFrame, distance: int = 4, crowd: int = 512, chosen: list[int] | None = None) -> DataFrame:
    """Distinct fingerprints to (a, b): enough links to connect all that lie within ``distance`` of each other.

    Values that up to ``crowd`` fingerprints share give each of their links once; fingerprints of more crowded
    values are linked by :func:`ball_links`, which grows with their number and not with its square.  A value without a
    bit is shared by those of two whole values, so counting whole values, a few a fingerprint, tells which may be crowded.
    """
    fps = cut(fps)
    chosen = chosen or masks(fps.count(), distance)
    whole = F.array(*[F.lit(_signed(m)) for m in chosen])
    heavy = fps.select("fp", F.posexplode(whole).alias("i", "m")).groupBy("i", F.col("fp").bitwiseAND(F.col("m")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    heavy = cut(heavy.where(F.col("n") > crowd // 2))
    values = variants(fps, chosen)
    some = not heavy.isEmpty()
    if some:
        wild = [(i, m & ~(1 << b)) for i, m in enumerate(chosen) for b in range(64) if m >> b & 1]
        tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for t, (i, m) in enumerate(wild)])
        busy = heavy.select("i", "v", F.explode(tags).alias("t")).where("t.i = i").select("t.tag", F.col("v").bitwiseAND(F.col("t.m")).alias("value"))
        busy = bounded(cut(busy.distinct()))
        crowded = cut(values.join(busy, ["tag", "value"], "left_semi").select("fp").distinct())
        values = values.join(busy, ["tag", "value"], "left_anti")
    few = cut(values.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("tag", "value"))).where("n > 1").drop("n"))
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    meet = (F.col("l.tag") == F.col("r.tag")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.fp") < F.col("r.fp"))
    found = few.alias("l").join(few.alias("r"), meet & (F.bit_count(x) <= distance) & first_tag(x, F.col("l.tag"), chosen))
    out = found.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    if some:
        out = out.unionByName(ball_links(crowded, (distance + 1) // 2).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return out


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, crowd: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp, component_id``: one row a document; component_id is the smallest key that its links reach, its own included.

    Null and empty texts have fingerprint 0 and are linked like any other.  Texts of equal fingerprint meet before
    any link is sought, so copies cost one row each.  Null keys never become a component's id unless it has no
    other.  Repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    own = cut(fingerprints(docs, width, text, key))
    least = cut(own.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")))
    root = components(links(least.select("fp"), distance, crowd))
    named = cut(least.join(root, least["fp"] == root["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("c"))
    of = join_hot(named, ids, "root", "c", named.count()).select("fp", "n", "component_id")
    return join_hot(own, of, "fp", "n", own.count()).select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 4, distance: int = 4, crowd: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows and columns of ``docs``, with one row of every component: that of the smallest key (nulls last), then of
    the smallest hash of its text; of rows alike in all columns but one stays."""
    row, h = unused(docs, "row"), unused(docs, "h")
    place = F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.xxhash64(key, text).alias("h"))
    found = near_duplicates(docs.withColumn(row, place), width, distance, crowd, text, row)
    found = cut(found.where(F.col(row) == F.col("component_id")).select(row))
    stay = found.select(F.col(f"{row}.h").alias(h)).distinct()
    out = docs.withColumn(h, F.xxhash64(key, text)).join(stay.hint("shuffle_hash"), h, "left_semi").drop(h)
    return out if found.count() == stay.count() else out.dropDuplicates([key, text])


def hexadecimal(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

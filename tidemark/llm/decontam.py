"""Benchmark decontamination by a prefix-filtered join (operator 3).

A window of an item's words occurs in a document only where all of its shingles do.  So it is enough to look for the
rarest of them: shingles are ordered by how often they occur in all documents, which one pass counts; each window is
indexed by its rarest, and a second pass joins the documents with these alone.  A shingle's place in the window gives
the place in the document, and the words there are compared with the window's.  Only documents that have a candidate
move; with few hits the others are read, counted and left where they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BROADCAST_ROWS, bounded, cut, fold

#: What stands between words, once A-Z are lower-case: all ASCII but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words where A-Z are not lower-case yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(fold(text), BETWEEN, -1), ""), F.array().cast("array<string>"))


def _shingle(at: Column, i: Column, k: int) -> Column:
    """The hash of the ``k`` words from place ``i`` on; ``k`` is part of it."""
    return F.xxhash64(F.lit(k), *[F.get(at, i + j) for j in range(k)])


def shingles(at: Column, k: int) -> Column:
    """The hashes of all runs of ``k`` words; none if there are fewer."""
    whole = F.transform(F.sequence(F.lit(0), F.size(at) - k), lambda i: _shingle(at, i, k))
    return F.when(F.size(at) >= k, whole).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, size: int, k: int, text: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): distinct windows as (wid, window, n, k, tokens), with tokens the hashes of the window's shingles
    in order, and (wid, window, item), one row for each item that has the window.

    A window is ``size`` consecutive words, or all words of an item that has fewer; one of fewer words than ``k`` is
    its own only shingle.
    """
    split = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    starts = split.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("s"))
    cutout = starts.select("item", "n", F.slice("w", F.col("s") + 1, F.col("n")).alias("w")).withColumn("window", F.array_join("w", " "))
    owners = cutout.select(F.xxhash64("window").alias("wid"), "window", "n", "w", "item").dropDuplicates(["wid", "window", "item"])
    owners = cut(owners)
    tokens = F.lit(None).cast("array<bigint>")
    for short in range(1, k + 1):
        tokens = F.when(F.col("k") == short, shingles(F.col("w"), short)).otherwise(tokens)
    distinct = owners.dropDuplicates(["wid", "window"]).withColumn("k", F.least("n", F.lit(k)))
    return cut(distinct.select("wid", "window", "n", "k", tokens.alias("tokens"))), owners.select("wid", "window", "item")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    shingle: int = 3,
    broadcast_rows: int = BROADCAST_ROWS,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key, n_words, n_hit, n_items, items, contaminated``: one row a document, with the columns named in ``keep``.

    A word is hit if it lies inside an occurrence of a window; ``items`` are the ids, as strings, of the items whose
    windows occur, sorted.  Null and empty texts have no words and no hits; items without words match nothing; a null
    item id reads "null"; items of equal id count as one; repeated documents are each judged; an empty table of documents gives no
    rows.  An empty benchmark leaves every document clean.  Documents are told apart by 128 bits of hashes of key and text, and
    candidates are verified word by word.  Other columns are not read.

    Tables of numbers with up to ``broadcast_rows`` rows are broadcast, and shuffled beyond.
    """
    windows, owners = item_windows(benchmark, size, shingle, text, item)
    tokens = windows.select("k", F.explode("tokens").alias("token")).distinct()
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())
    names = {c: f"_keep_{i}" for i, c in enumerate(keep) if c not in (key, text)}
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in names.items()])
    rows = rows.withColumn("r1", F.xxhash64("key", "text")).withColumn("r2", F.xxhash64("text", F.lit(7), "key"))
    own = [*names.values(), *["text"] * (text in keep)]
    row = ["r1", "r2"]
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")

    if lengths:
        split = rows.select(*row, words(F.col("text")).alias("w"))
        counted = [split.select(F.explode(shingles(F.col("w"), k)).alias("token")).join(bounded(tokens.where(F.col("k") == k).select("token"), broadcast_rows), "token") for k in lengths]
        often = cut(reduce(DataFrame.unionByName, counted).groupBy("token").agg(F.count(F.lit(1)).alias("often")))
        # Exact containment needs every shingle, so a prefix of one is enough: the rarest.  If one occurs nowhere, the window does not.
        placed = windows.select("wid", "window", "n", "k", F.posexplode("tokens").alias("offset", "token")).join(often, "token", "left")
        rarest = placed.groupBy("wid", "window", "n", "k").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token", "offset")).alias("rare"))
        prefix = cut(rarest.where("rare.often > 0").select("wid", "n", "k", "rare.token", "rare.offset"))
        at = [
            split.select(*row, F.posexplode(shingles(F.col("w"), k)).alias("at", "token")).join(bounded(prefix.where(F.col("k") == k).drop("k"), broadcast_rows), "token")
            for k in lengths
        ]
        start = (F.col("at") - F.col("offset")).alias("start")
        found = cut(reduce(DataFrame.unionByName, at).select(*row, start, "n", "wid").where("start >= 0"))
        by_row = found.groupBy(*row).agg(F.collect_set(F.struct("start", "n", "wid")).alias("cs"))
        texts = rows.select(*row, "text").join(bounded(found.select(*row).distinct(), broadcast_rows), row).dropDuplicates(row)
        pieces = texts.join(by_row, row).select(*row, words(F.col("text")).alias("w"), "cs")
        inside = F.filter("cs", lambda c: c["start"] + c["n"] <= F.size("w"))
        read = F.transform(inside, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["wid"].alias("wid"), F.array_join(F.slice("w", c["start"] + 1, c["n"]), " ").alias("window")))
        sound = cut(pieces.select(*row, F.explode(read).alias("c")).select(*row, "c.*").join(owners, ["wid", "window"]).select(*row, "start", "n", "item"))
        hit = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))))
        hits = cut(sound.groupBy(*row).agg(hit.cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")))
        load = hits.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("items", ",")))).first()
        side = F.broadcast(hits) if load[0] <= broadcast_rows and (load[1] or 0) <= 64 * broadcast_rows else hits.hint("shuffle_hash")
        rows = rows.select("key", *own, *row, n_words).join(side, row, "left")
    else:
        rows = rows.select("key", *own, n_words, F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))

    more = [*[F.col(n).alias(c) for c, n in names.items()], *[F.col("text").alias(text)] * (text in keep)]
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(F.col("key").alias(key), *more, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))

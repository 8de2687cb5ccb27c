"""Substring dedup by FM-indexes over shards of like content (operator 8).

Every window of ``width`` words is anchored at the least-hashed run of ``run`` words inside it, so equal windows have
equal anchors.  The windows that follow each other with one anchor form a segment.  Anchors that occur once cannot
hold a repeat and are dropped; the rest is sharded by anchor.  A shard builds an FM-index over its segments, by their
very words, and streams them through backward search.  Hashes only bring segments together: what is a repeat is read
from the index, word by word.

Copies of a segment (equal in a 128-bit BLAKE2b digest of their words) go into the index twice, and what it finds
for the first holds for all; an anchor that has copies of one segment alone is not searched.  An anchor with very many different segments is split by the words that all windows of
one block of places have in common, then by smaller blocks, until each part fits a shard.  Segments of anchors that are so
frequent take their words along from the first pass, so the texts do not move again for any of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.fm_index import FMIndex, repeated_windows
from tidemark.llm.shared import BROADCAST_ROWS, cut, hot_keys, join_spread

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Odd, so that powers have inverses modulo 2^64.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or have.size < n:
        have = np.full(max(n, 1 << 14), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have, dtype=np.uint64)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's bytes and the begin and end of each of its words."""
    data = np.frombuffer(raw, np.uint8)
    blank = np.concatenate(([True], _BLANK[data], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return data, edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: polynomials in their bytes, mixed with their lengths.  Equal words have equal hashes; different
    words may too, so hashes choose anchors and nothing else."""
    n = data.size
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BYTE, n), out=sums[1:])
    inverse = _power(_inverse(_BYTE), n + 1)
    return _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def anchors(h: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, the anchor's place) of a text's segments, from its words' hashes."""
    n = h.size
    if n < width:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
    runs = np.zeros(n - run + 1, np.uint64)
    for j in range(run):
        runs = runs * np.uint64(_WORD) + h[j : j + runs.size]
    runs = _mix(runs)
    span = width - run + 1
    place = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(n - width + 1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [n - width]))
    return runs[place[first]].view(np.int64), first, last, place[first]


def _digest(data: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64).tolist())


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, text, and two hashes of both that name the row."""
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.select(F.xxhash64("key", "text").alias("d1"), F.xxhash64("text", F.lit(7), "key").alias("d2"), "key", "text")


#: A segment of a row: its anchor, the digest of its words, its first and last window, its anchor's place, and the first
#: windows of the equal segments that follow in the same text; its words, where it takes them along.
_MEMBER = pa.schema([("anchor", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("pos", pa.int32()), ("more", pa.binary()), ("words", pa.binary())])
_MEMBER_SQL = "anchor long, w1 long, w2 long, d1 long, d2 long, first int, last int, pos int, more binary, words binary"
#: Anchors whose segments take their words along: so many at most, those of more than a share of all segments.
CARRIED = BROADCAST_ROWS


def _grouped(found: list[tuple], d1: int, d2: int) -> list[tuple]:
    """(anchor, w1, w2, first, last, pos, words) of one text to members, equal segments in one row: a line that a text
    repeats a thousand times is a row."""
    of: dict = {}
    for anchor, w1, w2, first, last, pos, words in found:
        of.setdefault((anchor, w1, w2, last - first, pos - first, words), []).append(first)
    return [(a, w1, w2, d1, d2, f[0], f[0] + n, f[0] + p, np.array(f[1:], "<i4").tobytes() if f[1:] else None, w) for (a, w1, w2, n, p, w), f in of.items()]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), schema.types)], schema=schema)


def _anchor_counts(rows: DataFrame, width: int, run: int) -> DataFrame:
    """(anchor, n): how many segments have an anchor, counted before they move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(word_hashes(*bounds(t.as_py().encode())), width, run)[0] for t in batch.column(0)]
            anchor, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return rows.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _members(rows: DataFrame, width: int, run: int, many: np.ndarray) -> DataFrame:
    """The segments of every text; those of the anchors ``many`` (sorted) with their words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for d1, d2, t in zip(*(batch.column(i) for i in range(3)), strict=True):
                joined = b" ".join(t.as_py().encode().split())
                data, begin, end = bounds(joined)
                cuts = anchors(word_hashes(data, begin, end), width, run)
                carry = many.take(np.searchsorted(many, cuts[0]), mode="clip") == cuts[0] if many.size else np.zeros(cuts[0].size, bool)
                some = zip(*(x.tolist() for x in (*cuts, begin[cuts[1]], end[cuts[2] + width - 1], carry)))
                out += _grouped([(a, *_digest(joined[b:e]), first, last, pos, joined[b:e] if c else None) for a, first, last, pos, b, e, c in some], d1.as_py(), d2.as_py())
                if len(out) > 20_000:
                    yield _batch(out, _MEMBER)
                    out = []
            if out:
                yield _batch(out, _MEMBER)

    return rows.select("d1", "d2", "text").mapInArrow(find, _MEMBER_SQL)


def _with_texts(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows with what is ``listed`` for them: (d1, d2, key, text, segments).  The key comes along so that the texts move
    as they do in :func:`without_repeats`, and one exchange serves both."""
    return rows.join(listed.hint("shuffle_hash"), ["d1", "d2"]).select("d1", "d2", "key", "text", "segments")


def _split(members: DataFrame, width: int, run: int, level: int) -> DataFrame:
    """Members, with their words, taken apart by the place of the anchor in the window, in 2^level blocks of places.

    All windows of a block have the words from the block's lowest to its highest place on in common, so equal windows
    agree in the digest of those, which is the part's anchor.  A block of one place has whole windows in common.
    """
    span = width - run + 1
    step = -(-span // (1 << level))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for s in batch.to_pylist():
                words, first, more = s["words"].split(), s["first"], np.frombuffer(s["more"] or b"", "<i4")
                # Word numbers within the segment.
                last, pos = s["last"] - first, s["pos"] - first
                for low in range(0, span, step):
                    high = min(low + step, span) - 1
                    a, b = max(0, pos - high), min(last, pos - low)
                    if a <= b:
                        common = b" ".join(words[pos - low : pos - high + width])
                        key = _digest(b"%d %d %d " % (s["anchor"], level, low) + common)[0]
                        own = b" ".join(words[a : b + width])
                        out.append((key, *_digest(own), s["d1"], s["d2"], first + a, first + b, first + pos, (more + a).astype("<i4").tobytes() if more.size else None, own))
                if len(out) > 5_000:
                    yield _batch(out, _MEMBER)
                    out = []
            if out:
                yield _batch(out, _MEMBER)

    return members.select(*_MEMBER.names).mapInArrow(part, _MEMBER_SQL)


_ASKED = pa.schema([("anchor", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("query", pa.bool_()), ("words", pa.binary())])
_ASKED_SQL = "anchor long, w1 long, w2 long, query boolean, words binary"


def _worded(rows: DataFrame, wanted: DataFrame, width: int, kinds: pa.Schema, sql: str) -> DataFrame:
    """The wanted segments (d1, d2, first, last and the columns of ``kinds``) with their words, joined by a space, out of
    the texts: the columns of ``kinds``."""
    plain = [c for c in kinds.names if c != "words"]
    listed = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct(*dict.fromkeys([*plain, "first", "last"]))).alias("segments"))

    def slice_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for t, segments in zip(batch.column(3), batch.column(4), strict=True):
                words = t.as_py().encode().split()
                out += [(*(s[c] for c in plain), b" ".join(words[s["first"] : s["last"] + width])) for s in segments.as_py()]
                if len(out) > 5_000:
                    yield _batch(out, kinds)
                    out = []
            if out:
                yield _batch(out, kinds)

    return _with_texts(rows, listed).mapInArrow(slice_out, sql)


def _search(segments: DataFrame, width: int, shards: int) -> DataFrame:
    """(anchor, w1, w2, found): for each query segment the stretches (a, b) of its words, counted from its first, that
    windows with a second occurrence cover; each shard by its own FM-index over the words themselves."""
    kinds = pa.schema([("anchor", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("found", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        split = pc.split_pattern(table.column("words").combine_chunks(), " ")
        ends = split.offsets.to_numpy()[1:].astype(np.int64)
        begins = ends - np.diff(split.offsets.to_numpy())
        coded = split.values.dictionary_encode()
        words, kinds_of = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        del split, coded
        index = FMIndex(words, ends, kinds_of)
        held = np.flatnonzero(table.column("query").to_numpy())
        marks = repeated_windows(index, words, begins[held], ends[held], width)
        # A segment's last words start no window, so stretches never run from one segment into the next.
        edge = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        of = np.searchsorted(ends, a, side="right")
        if not of.size:
            return
        hit, at = np.unique(of, return_index=True)
        pairs = pa.StructArray.from_arrays([pa.array((a - begins[of]).astype(np.int32)), pa.array((b - 1 + width - begins[of]).astype(np.int32))], ["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, of.size).astype(np.int32)), pairs)
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(pa.array(hit)) for c in ("anchor", "w1", "w2")), lists.cast(kinds.field("found").type)], schema=kinds)

    return segments.repartition(shards, "anchor").mapInArrow(search, "anchor long, w1 long, w2 long, found array<struct<a:int,b:int>>")


def repeats(docs: DataFrame, width: int = 35, run: int = 8, shard_words: int = 1_500_000, crowd: int = 1000, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, stretches): the documents as (d1, d2, key, text), and (d1, d2, first, more, found): what repeats in them, as
    stretches ``found`` of word numbers counted from ``first`` and from each place in ``more``.

    A shard holds about ``shard_words`` words, and no more than ``crowd`` segments of one anchor.  Anchors and segments
    that very many rows have are joined in parts.
    """
    rows = _rows(docs, text, key)
    often = cut(_anchor_counts(rows, width, run).where("n > 1"))
    row, total = ["d1", "d2", "first"], often.agg(F.sum("n")).first()[0] or 0
    # Fewer than CARRIED anchors can have more than that share of all segments.
    many = often.where(F.col("n") > max(crowd, total // CARRIED)).select("anchor").collect()
    many = np.sort(np.array([r.anchor for r in many], np.int64))
    found = cut(join_spread(_members(rows, width, run, many), often.select("anchor"), ["anchor"], hot_keys(often, ["anchor"], "n", total), row))
    of, out, level = ["anchor", "w1", "w2"], None, 0
    times = F.coalesce(F.octet_length("more") / 4, F.lit(0)).cast("long") + 1
    place = F.struct("d1", "d2", "first", "last")
    while True:
        classes = cut(found.groupBy(*of).agg(F.sum(times).alias("m"), F.min(place).alias("low"), F.max(place).alias("high"), F.min("words").alias("words")))
        twice = F.least("m", F.lit(2))
        load = classes.groupBy("anchor").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(twice).alias("c"))
        load = cut(load.where("n > 1"))
        total, kinds = (x or 0 for x in load.agg(F.sum("n"), F.sum("g")).first())
        loaded = join_spread(classes, load, ["anchor"], hot_keys(load, ["anchor"], "g", kinds), ["w1", "w2"])
        # Where all segments of an anchor are equal there is nothing to search for: each repeats the others whole.
        whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("low.last") - F.col("low.first") + width).alias("b"))).alias("found")
        alone = loaded.where("g = 1").select(*of, whole)
        # Parts of one place hold equal windows alone: two segments, whatever their number.
        most = crowd if width - run + 1 > 1 << level else max(crowd, 2)
        calm = loaded.where((F.col("g") > 1) & (F.col("c") <= most))
        # The least of a class asks; a copy of its own stands beside it where the class has more than one.
        asks = F.array(F.struct(F.lit(True).alias("query"), F.col("low").alias("p")), F.struct(F.lit(False).alias("query"), F.col("high").alias("p")))
        wanted = calm.select(*of, "words", F.explode(F.slice(asks, F.lit(1), twice.cast("int"))).alias("x")).select(*of, "x.query", "x.p.*", "words")
        words = calm.agg(F.sum((F.col("low.last") - F.col("low.first") + width) * twice)).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // shard_words))
        asked = wanted.where("words is not null").select(*_ASKED.names)
        if level == 0:
            asked = asked.unionByName(_worded(rows, wanted.where("words is null"), width, _ASKED, _ASKED_SQL))
        told = _search(asked, width, shards).unionByName(alone)
        hits = join_spread(found, told, of, hot_keys(classes, of, "m", total), row).select("d1", "d2", "first", "more", "found")
        out = hits if out is None else out.unionByName(hits)
        busy = load.where(F.col("c") > most).select("anchor")
        few = busy.limit(BROADCAST_ROWS + 1).count()
        if not few:
            return rows, out
        level += 1
        # Segments stay where they are while the crowded anchors are few enough to broadcast.
        if few <= BROADCAST_ROWS:
            crowded = found.join(F.broadcast(busy), ["anchor"])
        else:
            crowded = join_spread(found, busy, ["anchor"], hot_keys(load, ["anchor"], "n", total), row)
        if level == 1:
            # Crowded, but not among the most frequent anchors of all: their words come out of the texts.
            bare = cut(crowded.where("words is null"))
            if not bare.isEmpty():
                crowded = crowded.where("words is not null").select(*_MEMBER.names).unionByName(_worded(rows, bare, width, _MEMBER, _MEMBER_SQL))
        found = cut(_split(crowded, width, run, level))


def without_repeats(docs: DataFrame, width: int = 35, run: int = 8, shard_words: int = 1_500_000, crowd: int = 1000, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` (and ``kept`` if asked for): every text without the words of its
    repeated windows.

    A window is ``width`` consecutive words of one document; it repeats if its words start anywhere else, in the same
    document or another.  Null and empty texts have no words; texts of fewer words than ``width`` lose none; repeated
    rows repeat each other; an empty table gives no rows.  Windows are judged on the input.  Words are compared as
    such, in the index; copies of a segment are told by 128-bit BLAKE2b digests.  Other columns are not read.
    """
    rows, found = repeats(docs, width, run, shard_words, crowd, text, key)
    listed = found.groupBy("d1", "d2").agg(F.collect_list(F.struct("first", "more", "found")).alias("gone"))
    both = rows.join(listed.hint("shuffle_hash"), ["d1", "d2"], "left").select("key", "text", "gone")
    kind = docs.schema[key].dataType.simpleString()
    kinds = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())][: 4 if keep_text else 3])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.slice(at, 256), []
                for t, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words, n = t.encode().split(), 0
                    whole = len(words)
                    if gone:
                        marks = np.zeros(whole + 1, np.int64)
                        for g in gone:
                            begin = np.append(np.frombuffer(g["more"] or b"", "<i4"), g["first"]).astype(np.int64)
                            for s in g["found"]:
                                np.add.at(marks, begin + s["a"], 1)
                                np.add.at(marks, begin + s["b"], -1)
                        left = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
                        words = [words[i] for i in left.tolist()]
                        n = whole - len(words)
                    kept = b" ".join(words)
                    out.append((whole, n, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, k) for x, k in zip(zip(*out), kinds.types)]], ["key", *kinds.names])

    schema = f"key {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return both.mapInArrow(keep, schema).withColumnRenamed("key", key)

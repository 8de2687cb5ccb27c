"""Runs of periodic words by Lyndon arrays (operator 11).

A run is a stretch of words with smallest period q that is at least twice as long as q and that no neighbouring word
extends.  Every run has a Lyndon root that is the longest Lyndon word from its place on, in the order of the words or in
the reverse order, so both Lyndon arrays (edges from each place to the next smaller suffix) bring every run.  Suffixes
are compared word by word from left to right, and what an earlier comparison matched is not matched again: inside a
stretch that equals an earlier one the earlier edge's extension is taken over, and along a chain of smaller suffixes the
extension follows from the two before it.  No suffix structure is built, and no hash of any stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What one run is.
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_edges(w: list[int]) -> tuple[list[int], list[int]]:
    """(following, right) of words that end with a -1: the next smaller suffix after each place, and how many words both
    suffixes have in common.  ``following[i] - i`` is the Lyndon array."""
    n = len(w) - 1
    following, right, before, shared = [n] * n, [0] * n, [-1] * n, [0] * n
    reach = begin = shift = 0  # w[begin:reach] equals w[begin - shift : reach - shift]
    for i in range(1, n):
        j, k, settled = i - 1, 0, False
        while True:
            if not settled:
                if w[j] != w[i]:
                    k = 0
                else:
                    if i < reach and j >= begin:
                        a, b = j - shift, i - shift
                        same = right[a] if following[a] == b else shared[b] if before[b] == a else 0
                        settled = 0 < same < reach - i
                        k = same if settled else max(k, min(same, reach - i))
                    if not settled:
                        while w[j + k] == w[i + k]:
                            k += 1
                        if i + k > reach:
                            reach, begin, shift = i + k, i, i - j
            if w[j + k] < w[i + k]:
                before[i], shared[i] = j, k
                break
            following[j], right[j] = i, k
            up, j = shared[j], before[j]
            if j < 0:
                break
            # The suffix between both matches either of them; unless equally far, the shorter match is theirs, too.
            settled = k != up
            if up < k:
                k = up
    return following, right


def runs_of(w: list[int]) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of two periods or more; words are numbers from 0 on."""
    n, top, found = len(w), max(w, default=0), set()
    for order in (w, [top - x for x in w]):
        following, right = lyndon_edges([*order, -1])
        left = [0] * n
        reach = end = shift = n  # order[x] equals order[x + shift] for reach < x <= end
        for i in range(n - 1, 0, -1):
            if not right[i]:
                continue
            q = following[i]
            x, y, k = i - 1, q - 1, 0
            if reach < x and y <= end and following[i + shift] == q + shift and right[i + shift]:
                k = min(left[i + shift], x - reach)
            if k == x - reach or not k:
                while x - k >= 0 and order[x - k] == order[y - k]:
                    k += 1
                if x - k < reach:
                    reach, end, shift = x - k, x, q - i
            left[i] = k
        for i in range(n):
            p = following[i] - i
            if right[i] and left[i] + right[i] >= p:
                found.add((i - left[i], left[i] + p + right[i], p))
    return found


def pieces(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches outside of which there is no run: of ``least`` words or more, each word at least twice.

    A word of a run stands twice in it, so a word that a stretch has once is in no run, and extends none.  Leaving such
    words out makes new stretches, until nothing changes.
    """
    place, of = np.arange(codes.size), np.zeros(codes.size, np.int64)
    while place.size:
        _, back, times = np.unique(of * (codes.size + 1) + codes[place], return_inverse=True, return_counts=True)
        stays = times[back] > 1
        kept = place[stays]
        of = np.cumsum(np.concatenate(([0], (np.diff(kept) != 1) | (np.diff(of[stays]) != 0)))) if kept.size else of[:0]
        wide = np.bincount(of, minlength=1)[of] >= least if kept.size else np.zeros(0, bool)
        done = stays.all() and wide.all()
        place, of = kept[wide], of[wide]
        if done:
            break
    if not place.size:
        return []
    edge = np.flatnonzero(np.diff(of)) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(place, edge)]


def find_runs(words: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs of ``least`` words or more, by start and then period."""
    if len(words) < least:
        return []
    numbers = {x: i for i, x in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    out = [(a + s, n, p) for a, b in pieces(codes, least) for s, n, p in runs_of(codes[a:b].tolist()) if n >= least]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(runs).T
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


def collapse(docs: DataFrame, least: int = 12, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, runs, kept``: each text's runs of ``least`` words or more as (start, length, period) by start and
    then period, counted in words from 0, and its words, joined by a space, without what runs repeat.

    Words are separated by ASCII white space.  Null and empty texts have no words and no runs.  Rows are worked on where
    they lie, one text at a time, so repeated rows and keys, null keys and ties come out as they went in, and a long text
    costs time in proportion to its words.  An empty table gives no rows.  Other columns are not read.
    """
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part, sizes, all_runs, kept = batch.slice(at, 128), [], [], []
                for t in part.column(1):
                    words = t.as_py().encode().split()
                    runs = find_runs(words, least)
                    sizes.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    kept.append(b" ".join(without_runs(words, runs)).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(all_runs, pa.list_(_RUN)), pa.array(kept, pa.string())], ["key", "n_words", "runs", "kept"])

    out = slim.mapInArrow(find, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")
    return out.withColumnRenamed("key", key)

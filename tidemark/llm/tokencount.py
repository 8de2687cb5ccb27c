"""Token counts with a whole-token shortcut (operator 4).

The model's pieces hold the word mark only as a prefix, so no merge crosses from a character into a following mark:
a text splits there into pre-tokens that encode independently.  Which vocabulary strings encode alone as one token is
proven once, by encoding each of them; pre-tokens among those count as one, and only the rest are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: U+2581, which the model writes for a space.
MARK = "▁"
#: Pre-tokens whose counts a worker keeps before it starts anew.
MEMORY = 200_000


@lru_cache(maxsize=4)
def _model(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


@lru_cache(maxsize=4)
def whole_tokens(proto: bytes) -> frozenset[str]:
    """The vocabulary strings that encode alone as exactly their own id, written as pre-tokens without their first mark.

    Raises ValueError if the model could merge across a word mark, as pre-tokens would then not be independent.
    """
    model = _model(proto)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces) or model.encode("a" + MARK) != model.encode("a "):
        raise ValueError("the model has pieces that reach over a word mark")
    first = model.encode("a b", out_type=str)
    if not first or not first[0].startswith(MARK) or model.encode("a", out_type=str) == model.encode(" a", out_type=str):
        raise ValueError("the model does not put a word mark before every text, or drops white space")
    tried = [(i, p[1:]) for i, p in enumerate(pieces) if p.startswith(MARK) and not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return frozenset(p for (i, p), ids in zip(tried, model.encode([p for _, p in tried], num_threads=1), strict=True) if ids == [i] and p)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text that isn't empty, without the first mark of each: ``▁*[^▁]*`` pieces."""
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts[:-1]:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    out.append(" " * run + parts[-1])
    return out


class Counts:
    """Tokens of texts, with the counts of recent pre-tokens kept."""

    def __init__(self, proto: bytes, shortcut: frozenset[str]):
        self.model, self.start = _model(proto), dict.fromkeys(shortcut, 1)
        self.known = dict(self.start)

    def many(self, texts: list[str]) -> list[int]:
        split = [Counter(pre_tokens(t)) if t else {} for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > MEMORY + len(self.start):
            self.known = dict(self.start)
            new = list({w for words in split for w in words if w not in self.known})
        # An empty pre-token is a lone mark, which the model drops if it is asked for an empty text.
        known = self.known
        for w, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            known[w] = len(ids) if w else 1
        return [sum(known[w] * n for w, n in words.items()) for words in split]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, block: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit``: what the model gives for each whole text, without added tokens.

    The model's file (a proven bound: its size doesn't depend on the data) is read here and sent to the tasks with
    the proven strings.  Null text counts as empty: 0 bytes, 0 tokens.  No shuffle; rows with equal keys stay apart;
    a text of any length is one unit of work, and others are counted ``block`` at a time.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((proto, whole_tokens(proto)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*sent.value)
        for batch in batches:
            n: list[int] = []
            texts = batch.column(1)
            for at in range(0, len(texts), block):
                n += counts.many([x or "" for x in texts.slice(at, block).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    length = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), length.alias("n_bytes"))
    out = slim.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

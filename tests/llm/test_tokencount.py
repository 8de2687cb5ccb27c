from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")
PROTO = open(PATH, "rb").read()
MODEL = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
COUNTS = tokencount.Counts(PROTO, tokencount.whole_tokens(PROTO))

ODD = ["", " ", "  ", " a", "a ", "a  b   c", "▁", "▁▁a", "a▁b", "\n", " \n x", "<s> </s> <unk>", "é é ﬁ №", "\x00\x01", "日本語 テキスト", "😀😀 x", "a　b c", "the " * 3000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert COUNTS.many([text]) == [len(MODEL.encode(text))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eé▁\n\t<>1.日"), max_size=30), max_size=4))
def test_any_texts(texts):
    assert COUNTS.many(texts) == [len(MODEL.encode(t)) for t in texts]


def test_shortcut_is_proven():
    whole = tokencount.whole_tokens(PROTO)
    assert len(whole) > 10_000
    assert all(len(MODEL.encode(w)) == 1 for w in list(whole)[:2000])


def test_whole_documents(docs, corpus, no_docs):
    got = tokencount.count_tokens(docs, PATH, limit=500).collect()
    want = [(i, len((t or "").encode()), n := len(MODEL.encode(t or "")), n > 500) for i, t, *_ in corpus]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(no_docs, PATH).count() == 0


def test_small_memory(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMORY", 3)
    counts = tokencount.Counts(PROTO, tokencount.whole_tokens(PROTO))
    texts = [f"word{i} qzx{i} other" for i in range(30)]
    assert [counts.many([t])[0] for t in texts] == [len(MODEL.encode(t)) for t in texts]

from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard

from tidemark.llm import warc


def plain(rows):
    found = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == data and j is not None] if len(data) >= 1000 else []
        to = max(same) if same and len([1 for _, _, x in rows if (x or "").encode() == data]) > 1 and max(same) != i else None
        found.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(found, key=str)


def pages(spark, clash, n=40):
    rows = [(i, f"http://x/{i}?q=é \r\nEvil: 1", f"<p>{i}</p>" * (i * 7)) for i in range(n)]
    rows += [(100 + i, None, "<b>same</b>" * 120) for i in range(30)] + [(200 + i, "u", "tiny") for i in range(5)] + [(300, "u", None), (301, "u", ""), (129, "twice", "<b>same</b>" * 120), (None, "u", "<i>é</i>" * 300), (7, "other", "<i>é</i>" * 300), (400, "big", "é" * 700_000)]
    return rows, clash(spark.createDataFrame(rows, "page_id long, url string, html string"))


@pytest.mark.parametrize("most", [10**6, 0])
def test_matches_brute_force(spark, clash, monkeypatch, most):
    """Digests that repeat go to the pages, or, where they are many, pages and digests meet."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rows, df = pages(spark, clash)
    got = warc.archive(df.repartition(3), payload=True).collect()
    number = lambda x: None if x in (None, "null") else int(x)
    assert sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got), key=str) == plain(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == texts[number(r.page_id)] for r in got if r.record_type == "response" and number(r.page_id) not in (7,))


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(none).count() == 0
    assert warc.archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).first().payload_bytes == 1


def one(payload=b"<p>x</p>" * 40, **changes):
    return warc.record("1", "http://x", payload, hashlib.sha1(payload).hexdigest(), changes.get("to"))


def test_frames_and_dictionary():
    words = [(f"<html><body class='c{i}'>" + "lorem ipsum " * 20).encode() for i in range(200)]
    held = zstandard.train_dictionary(2048, words)
    pack = zstandard.ZstdCompressor(dict_data=held)
    records = [one(w) for w in words[:50]] + [one(b"z" * 100_000)]
    for stored in (held.as_bytes(), zstandard.compress(held.as_bytes())):
        whole = struct.pack("<II", warc.DICTIONARY_FRAME, len(stored)) + stored + pack.compress(records[0]) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + b"".join(map(pack.compress, records[1:]))
        for chunk in (7, 16_384):
            assert [r for _, r in warc.frames(io.BytesIO(whole), chunk)] == records
        for cut in (4, 20, len(whole) - 5):
            with pytest.raises((ValueError, zstandard.ZstdError)):
                list(warc.frames(io.BytesIO(whole[:cut])))
    with pytest.raises(ValueError, match="no Zstandard frame"):
        list(warc.frames(io.BytesIO(b"notaframe")))


@pytest.mark.parametrize("damage", [lambda r: r[:-1], lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: 4", b"Content-Length: 5", 1), lambda r: r.replace(b"<p>x</p>", b"<p>y</p>", 1), lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"), lambda r: r + b"x"])
def test_damaged_records_are_refused(damage):
    assert warc.parse(one())["payload"] == b"<p>x</p>" * 40
    with pytest.raises((ValueError, KeyError)):
        warc.parse(damage(one()))

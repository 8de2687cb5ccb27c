from __future__ import annotations

import hashlib
import zlib

import pytest

from tidemark.llm import media


def payload(t):
    data = (t or "").encode()
    return data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")


def test_round_trip_of_all_documents(docs, corpus, tmp_path):
    got = media.media_columns(docs, f"file://{tmp_path}/m").collect()
    want = [(i, len((t or "").encode()), len(p := payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for i, t, *_ in corpus]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        assert by.setdefault((r.payload_sha256, r.n_bytes), tuple(r)[1:]) == tuple(r)[1:]


def test_ranges_and_rolls_change_nothing(spark, docs, tmp_path):
    media.store(docs, f"file://{tmp_path}/m")
    read = lambda **o: sorted((r.member, bytes(r.media)) for r in spark.read.format("media_zip").options(**o).load(f"file://{tmp_path}/m").collect())
    whole = read()
    assert len(whole) == docs.count() and read(range_bytes=700, batch_bytes=50) == whole
    rows = spark.createDataFrame([(f"{i}.png", 0, bytes([i]) * 500) for i in range(50)], "member string, offset long, media binary")
    rows.write.format("media_zip").option("roll", 2000).mode("append").save(f"file://{tmp_path}/r")
    assert len(list((tmp_path / "r").glob("*.zip"))) > 10
    assert {(r.member, bytes(r.media)[0]) for r in spark.read.format("media_zip").load(f"file://{tmp_path}/r").collect()} == {(f"{i}.png", i) for i in range(50)}


def test_appends_add_and_an_overwrite_replaces(spark, tmp_path):
    def write(names, mode):
        rows = spark.createDataFrame([(n, 0, n.encode()) for n in names], "member string, offset long, media binary")
        rows.coalesce(2).write.format("media_zip").mode(mode).save(f"file://{tmp_path}/a")

    read = lambda: sorted(r.member for r in spark.read.format("media_zip").load(f"file://{tmp_path}/a").collect())
    spark.dataSource.register(media.MediaZip)
    write(["a", "b"], "append")
    write(["c"], "append")
    assert read() == ["a", "b", "c"]
    write(["d", "e"], "overwrite")
    assert read() == ["d", "e"]
    write(["f"], "append")
    assert read() == ["d", "e", "f"]


def test_keys_of_any_text(spark, tmp_path):
    keys = ["x.png.1", "x.png.2", "null", "a/b", "n", "k", "", "ü +%20", None]
    got = media.media_columns(spark.createDataFrame([(k, f"text of {k}") for k in keys], "doc_id string, text string"), f"file://{tmp_path}/k").collect()
    assert {(r.doc_id, r.n_bytes) for r in got} == {(k, len(f"text of {k}".encode())) for k in keys}


def test_strays_are_not_read(spark, docs, tmp_path):
    media.store(docs, f"file://{tmp_path}/m")
    name = next((tmp_path / "m").glob("*.zip"))
    (tmp_path / "m" / "part-stray.zip").write_bytes(name.read_bytes())
    assert spark.read.format("media_zip").load(f"file://{tmp_path}/m").count() == docs.count()


class Flaky:
    def __init__(self, data, failures):
        self.data, self.failures, self.opened = data, failures, 0

    def open_input_file(self, path):
        self.opened += 1
        broken = self.opened <= self.failures
        outer = self

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                return False

            def read_at(self, n, at):
                data = outer.data[at : at + n]
                return data[:-1] if broken else data

        return File()


def test_members_are_retried_by_offset(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one", b"1" * 300)
        z.writestr("two", b"2" * 300)
        at = z.infolist()[1]
    data = (tmp_path / "a.zip").read_bytes()
    fs = Flaky(data, 2)
    assert media.read_member(fs, "a", at.header_offset, 300, at.CRC, wait=0) == b"2" * 300 and fs.opened == 3
    with pytest.raises(OSError, match="at"):
        media.read_member(Flaky(data, 9), "a", at.header_offset, 300, at.CRC, wait=0)


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 192, bytes(range(256)) * 3])
def test_images(data):
    image = media.to_png(data)
    samples, n = media.from_png(image)
    assert n == len(data) and samples.tobytes() == data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
    with pytest.raises(ValueError):
        media.from_png(image[:40] + bytes([image[40] ^ 1]) + image[41:])


def test_empty(no_docs, tmp_path):
    assert media.media_columns(no_docs, f"file://{tmp_path}/e").count() == 0

"""Zstandard WARC archives: writing with revisits, and reading back frame by frame (operator 9).

An archive starts with a skippable frame that holds the dictionary; each record follows in a frame of its own.
Tasks write archives into the shared folder and pass on a manifest, so files of failed attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BROADCAST_ROWS, cut, join_hot, new_folder, open_fs

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def train(pages: DataFrame, html: str, sample: int = 256, size: int = 16_384) -> bytes:
    """A dictionary from at most ``sample`` pages, of which up to 16 KB each are looked at; empty if they are too few.

    Any pages do, as the dictionary changes how small the records are and nothing that is read back from them.
    """
    import zstandard

    rows = [r[0].encode() for r in pages.select(F.substring(html, 1, 16_384)).where(F.col(html).isNotNull()).limit(sample).collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes() if len(rows) > 16 else b""
    except zstandard.ZstdError:
        return b""


def with_revisits(pages: DataFrame, least: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, html, digest, refers_to``: refers_to is the largest page_id with an equal payload.

    It is null for payloads under ``least`` bytes, for payloads that occur once, and for the page that others refer to
    (all its rows, should the id repeat).  Null html is an empty payload; null ids come before all others.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = F.octet_length("html") >= least
    # Digests alone are counted; where few repeat, these go to the pages and no payload moves.
    copies = cut(rows.where(large).groupBy(F.col("digest").alias("_key")).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    if copies.count() <= BROADCAST_ROWS:
        joined = rows.withColumn("_key", F.when(large, F.col("digest"))).join(F.broadcast(copies), "_key", "left")
    else:
        spread = F.concat(F.lit("small-"), F.pmod(F.xxhash64("page_id", "url"), F.lit(100_000)).cast("string"))
        joined = join_hot(rows.withColumn("_key", F.when(large, F.col("digest")).otherwise(spread)), copies, "_key", "_n", rows.count())
    other = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("_last")).alias("refers_to"))


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, roll: int = 32 << 20) -> DataFrame:
    """Write :func:`with_revisits` rows into archives of about ``roll`` bytes each; returns ``path, records, bytes``.

    The manifest is cut, so each archive that it names is written once and complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task, k = TaskContext.get(), 0
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=True)
        lead = b""
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            lead = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        out, size, n = [lead], len(lead), 0

        def done() -> pa.RecordBatch:
            name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.warc.zst"
            with fs.open_output_stream(name) as f:
                for x in out:
                    f.write(x)
            return pa.RecordBatch.from_pylist([{"path": name, "records": n, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            ids, urls, html, digests, refers = (batch.column(i) for i in range(5))
            for i in range(len(ids)):
                x = pack.compress(record("null" if ids[i].as_py() is None else "id:" + quote(ids[i].as_py(), safe=""), urls[i].as_py() or "", html[i].as_py().encode(), digests[i].as_py(), None if refers[i].as_py() is None else "id:" + quote(refers[i].as_py(), safe="")))
                out.append(x)
                size, n = size + len(x), n + 1
                if size >= roll:
                    yield done()
                    out, size, n, k = [lead], len(lead), 0, k + 1
        if n:
            yield done()

    slim = rows.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    return cut(slim.mapInArrow(run, "path string, records long, bytes long"))


def frames(stream, chunk: int = 16_384) -> Iterator[tuple[int, bytes]]:
    """(number, record) of an archive: one decoded frame each, with the dictionary that its first frame brings."""
    import zstandard

    held, rest, number, first = None, b"", 0, True

    def more(at_least: int) -> bool:
        nonlocal rest
        while len(rest) < at_least and (x := stream.read(max(chunk, at_least - len(rest)))):
            rest += x
        return len(rest) >= at_least

    while more(1):
        if not more(8):
            raise ValueError("an archive ends inside a frame's head")
        magic, size = struct.unpack("<II", rest[:8])
        if magic in SKIPPABLE:
            if not more(8 + size):
                raise ValueError("an archive ends inside a skippable frame")
            if first and magic == DICTIONARY_FRAME:
                raw = rest[8 : 8 + size]
                held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
            rest, first = rest[8 + size :], False
            continue
        if rest[:4] != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame after record {number}")
        one, parts, first = zstandard.ZstdDecompressor(dict_data=held).decompressobj(), [], False
        while not one.eof:
            if not more(1):
                raise ValueError(f"an archive ends inside record {number}")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield number, b"".join(parts)
        number += 1


def parse(raw: bytes) -> dict:
    """A record's fields as :data:`RECORD` has them, and its payload; ValueError if its head, length or digest is wrong."""
    head, found, after = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1") or any(": " not in x for x in lines[1:]):
        raise ValueError("a malformed record head")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    n = int(fields["content-length"])
    if len(after) != n + 4 or after[n:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(after) - 4} bytes where the head says {n}")
    http, found, payload = after[:n].partition(b"\r\n\r\n")
    stated = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])}
    kind, size = fields["warc-type"], int(stated["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind not in ("response", "revisit") or not found:
        raise ValueError(f"an unexpected record of type {kind}")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload that its digest or length does not fit")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")

    def name(k: str) -> str | None:
        own = fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")
        return unquote(own[3:]) if own.startswith("id:") else None

    return {"page_id": name("warc-record-id"), "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": name("warc-refers-to"), "payload": payload}


def read_archives(manifest: DataFrame, folder: str, payload: bool = False, block: int = 4 << 20) -> DataFrame:
    """The records of every archive that the manifest names, with their ``payload`` if asked for.

    One archive is one unit of work; it streams, holding one record and a batch of about ``block`` bytes.
    """
    schema = RECORD + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = pa.schema([(n, {"payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(path) as stream:
                    for number, raw in frames(stream):
                        try:
                            found = parse(raw)
                        except (ValueError, KeyError) as e:
                            raise ValueError(f"{path}, record {number}: {e}") from e
                        rows.append({k: found[k] for k in names})
                        seen, size = seen + 1, size + 200 + (len(raw) if payload else 0)
                        if size >= block:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                if seen != n:
                    raise ValueError(f"{path} holds {seen} records where {n} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return manifest.select("path", "records").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, least: int = 1000, payload: bool = False) -> DataFrame:
    """Write the pages as WARC archives and read the records back.

    Null html is an empty payload, a null url an empty one (its control characters are percent-encoded), a null
    page_id is read back as null, and any text as itself; repeated rows are repeated records; an empty table
    writes no archive.  Other columns are not read.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    manifest = write_archives(with_revisits(pages, least), folder, train(pages, "html"))
    return read_archives(manifest, folder, payload)

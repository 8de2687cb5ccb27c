"""Media columns over archives: a Spark data source that plans byte ranges and reads members by offset (operator 10).

Payloads are kept as 8-bit grey PNG images of 192 samples a row, inside zip archives.  ``format("media_zip")`` writes
a folder of archives and reads one: a partition is a byte range of one archive, and takes the members that start
inside it.  Members are read one by one from their own offsets, each with its own retries and checksum.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.llm.shared import new_folder, open_fs

SIDE = 192
PNG = b"\x89PNG\r\n\x1a\n"
#: One manifest a commit, under a name of its own: its archives, and the manifests that it replaces.
MANIFEST = "_manifest-"
ARROW = pa.schema([("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


def read_member(fs, path: str, offset: int, packed: int, crc: int, tries: int = 4, wait: float = 0.2) -> bytes:
    """A stored member's bytes, from its local head at ``offset``; read anew, from the open on, if that fails."""
    for left in reversed(range(tries)):
        try:
            with fs.open_input_file(path) as f:
                head = f.read_at(30, offset)
                if len(head) != 30 or head[:4] != b"PK\x03\x04":
                    raise ValueError("no member's head")
                name, extra = struct.unpack("<HH", head[26:30])
                data = f.read_at(packed, offset + 30 + name + extra)
            if len(data) != packed or zlib.crc32(data) != crc:
                raise ValueError("a checksum that does not fit")
            return data
        except (OSError, ValueError) as e:
            if not left:
                raise OSError(f"{path} at {offset}: {e}") from e
            time.sleep(wait * (tries - left))
    raise AssertionError


def manifests(fs, root: str) -> dict[str, list]:
    """The archives (name, bytes) of every manifest that none replaces."""
    from pyarrow.fs import FileSelector

    found = {}
    for x in fs.get_file_info(FileSelector(root, allow_not_found=True)):
        if x.base_name.startswith(MANIFEST):
            with fs.open_input_stream(x.path) as f:
                found[x.base_name] = json.loads(f.read())
    gone = {name for x in found.values() for name in x["replaces"]}
    return {name: x["files"] for name, x in sorted(found.items()) if name not in gone}


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, batch_bytes: int):
        self.folder, self.range_bytes, self.batch_bytes = folder, range_bytes, batch_bytes

    def partitions(self) -> list[Range]:
        fs, root = open_fs(self.folder)
        from pyarrow.fs import FileSelector

        found = manifests(fs, root)
        if found:
            files = [x for some in found.values() for x in some]
        else:
            files = [(x.base_name, x.size) for x in fs.get_file_info(FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".zip")]
        cuts = [Range(f"{root}/{n}", at, min(size, at + self.range_bytes)) for n, size in files for at in range(0, size, self.range_bytes)]
        return cuts or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = open_fs(self.folder)
        with fs.open_input_file(part.path) as f, zipfile.ZipFile(f) as archive:
            members = [(x.filename, x.header_offset, x.compress_size, x.CRC) for x in archive.infolist() if part.start <= x.header_offset < part.end]
        rows, size = [], 0
        for name, offset, packed, crc in members:
            data = read_member(fs, part.path, offset, packed, crc)
            rows.append((name, offset, data))
            size += len(data)
            if size >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ARROW.types)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives of about ``roll`` bytes; the driver's manifest names those of tasks that ended well.

    Appends add a manifest; an overwrite's manifest also names those that it replaces, so readers see the old archives
    or the new ones and never both.
    """

    def __init__(self, folder: str, roll: int, overwrite: bool):
        self.folder, self.roll, self.overwrite = folder, roll, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.folder)
        fs.create_dir(root, recursive=True)
        files: list = []
        out = archive = None

        def close() -> None:
            archive.close()
            name = f"part-{TaskContext.get().partitionId():06d}-{len(files)}-{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(out.getbuffer())
            files.append((name, out.getbuffer().nbytes))

        for batch in iterator:
            members, media = batch.column(batch.schema.get_field_index("member")), batch.column(batch.schema.get_field_index("media"))
            for i in range(len(members)):
                if archive is None:
                    out = io.BytesIO()
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(members[i].as_py()), media[i].as_py())
                if out.tell() >= self.roll:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = open_fs(self.folder)
        fs.create_dir(root, recursive=True)
        old = sorted(manifests(fs, root)) if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps({"files": [x for m in messages if m for x in m.files], "replaces": old}).encode())

    def abort(self, messages) -> None:
        """Nothing to undo: files that no manifest names are not read."""


class MediaZip(DataSource):
    """``format("media_zip")``; options path, range_bytes, batch_bytes, roll."""

    @classmethod
    def name(cls) -> str:
        return "media_zip"

    def schema(self) -> str:
        return "member string, offset long, media binary"

    def _option(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self._option("range_bytes", 8 << 20), self._option("batch_bytes", 4 << 20))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self._option("roll", 32 << 20), overwrite)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """Bytes as a grey image, padded with spaces to whole rows (one at least); their number goes into a text chunk."""
    rows = max(1, -(-len(data) // SIDE))
    grid = np.zeros((rows, SIDE + 1), np.uint8)
    grid[:, 1:] = np.frombuffer(data.ljust(rows * SIDE, b" "), np.uint8).reshape(rows, SIDE)
    head = struct.pack(">IIBBBBB", SIDE, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(grid.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows x 192) and the number of bytes before padding; ValueError if the image is damaged."""
    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    at, chunks = 8, {}
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"a damaged chunk at {at}")
        chunks[kind] = chunks.get(kind, b"") + data
        at += 12 + n
    width, height, *mode = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    grid = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if mode != [8, 0, 0, 0, 0] or grid[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey image")
    return grid[:, 1:], int(chunks[b"tEXt"].split(b"\0")[1])


def feature(samples: np.ndarray) -> str:
    """Rows, mean, root mean square, and the shares of the four quarters of the value range."""
    flat = samples.ravel()
    bins = np.bincount(flat, minlength=256).astype(np.int64)
    values = np.arange(256)
    n = int(flat.size)
    quarters = ",".join(f"{x / n:.4f}" for x in bins.reshape(4, 64).sum(1).tolist())
    return f"rows={samples.shape[0]};mean={int(bins @ values) / n:.4f};rms={(int(bins @ (values * values)) / n) ** 0.5:.4f};quarters={quarters}"


def member_name(key: str | None) -> str:
    """A key as a member's name: percent-encoded behind a "k", so that no key looks like another; null is "n"."""
    return "n.png" if key is None else f"k{quote(key, safe='')}.png"


def member_key(member: str) -> Column:
    """The key of a member of that name."""
    return F.when(F.col(member).startswith("k"), F.url_decode(F.expr(f"substring({member}, 2, length({member}) - 5)")))


def store(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id") -> None:
    """Write every text as a member of archives in ``folder``."""
    docs.sparkSession.dataSource.register(MediaZip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                media = [to_png((x or "").encode()) for x in part.column(1).to_pylist()]
                names = [member_name(k) for k in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["member", "media"])

    slim = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    slim.mapInArrow(run, "member string, media binary").select("member", F.lit(0).cast("long").alias("offset"), "media").write.format("media_zip").mode("append").save(folder)


def features(media: DataFrame) -> DataFrame:
    """``member`` with what its image holds: sizes, digests and the feature string."""
    names = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    kinds = pa.schema([("member", pa.string())] + [(n, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                image = batch.column(1)[i].as_py()
                samples, n = from_png(image)
                data = samples.tobytes()
                values = (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples))
                rows.append({"member": batch.column(0)[i].as_py(), **dict(zip(names, values, strict=True))})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    schema = "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("member", "media").mapInArrow(run, schema)


def media_columns(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store every text as an image, read the archives back, and compute features of the bytes read.

    Null and empty texts are one row of 192 spaces with ``n_bytes`` 0.  Rows with equal keys are members of their own;
    a null key is read back as null, and any text as itself (up to the 65,535 bytes that a member's name may have).  An empty table gives an archive folder with an empty manifest, and no rows.  A
    text is one member however long it is; other columns are not read.  The key's type is kept.
    """
    folder = folder or new_folder(docs.sparkSession, "media")
    store(docs, folder, text, key)
    media = docs.sparkSession.read.format("media_zip").load(folder)
    found = member_key("member").cast(docs.schema[key].dataType).alias(key)
    out = features(media)
    return out.select(found, *[c for c in out.columns if c != "member"])

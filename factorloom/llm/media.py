"""Media columns: payloads as image files in archives, and a data source that reads them back.

Writing: each payload, padded with zero bytes to a positive multiple of 64, becomes an 8-bit
greyscale PNG of 64 columns (lossless); each task puts its images into archives (ZIP, members
stored as they are).  Reading: the data source ``media_archive`` plans byte ranges of archives
without looking inside them, either of all archives below given folders or of those that a manifest
names with their sizes.  A range's reader takes the members that begin in it: it reads them in runs,
streams them in Arrow batches, and reads a member that failed (or whose run did) again by its own
offset.  So a lost executor costs the byte ranges it was at, and a bad read costs one member.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import arrow_map, materialise, scratch

COLUMNS = 64
#: Bytes of an archive, of a byte range of it, of one run of reads, and attempts for a member.
ARCHIVE_BYTES, RANGE_BYTES, RUN_BYTES, ATTEMPTS = 64 << 20, 8 << 20, 1 << 20, 3
#: Partitions at most: beyond, each has several ranges.
MOST_PARTITIONS = 50_000
PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(raw: bytes) -> bytes:
    """The padded payload as an 8-bit greyscale image; its length before padding is in a text chunk."""
    size = max(COLUMNS, -(-len(raw) // COLUMNS) * COLUMNS)
    rows = size // COLUMNS
    lines = np.zeros((rows, COLUMNS + 1), np.uint8)
    flat = np.zeros(size, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    lines[:, 1:] = flat.reshape(rows, COLUMNS)
    head = struct.pack(">IIBBBBB", COLUMNS, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"length\0" + str(len(raw)).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """Samples and the payload's length before padding; a damaged image raises ValueError."""
    if data[:8] != PNG:
        raise ValueError("not an image")
    at, body, length, rows = 8, [], None, 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            rows = struct.unpack_from(">I", part, 4)[0]
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"tEXt" and part.startswith(b"length\0"):
            length = int(part[7:])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, COLUMNS + 1)
    if length is None or lines[:, 0].any():
        raise ValueError("not an image of this writer")
    return lines[:, 1:].tobytes(), length


def features(samples: bytes) -> str:
    """Mean, standard deviation, entropy and the sixteen-bin shares (per mille) of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float((share * np.arange(256)).sum())
    dev = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    some = share[share > 0]
    bins = np.round(share.reshape(16, 16).sum(axis=1) * 1000).astype(int)
    return f"mean={mean:.4f};sd={dev:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};bins={'.'.join(map(str, bins))}"


def write_archives(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one image for each row into archives; returns the manifest (path, n_members, n_bytes).

    The manifest is written before it is returned; archives of failed attempts are in no manifest.
    Null text: an empty payload.  A null id has an empty id in its member's name.  Repeated rows are
    repeated members.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "media")
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, n, archive, out = TaskContext.get().partitionId(), 0, None, None
        name = ""

        def close():
            archive.close()
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_members": [n], "n_bytes": [size]}, schema=pa.schema([("path", pa.string()), ("n_members", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                if archive is None:
                    name, n = f"part-{part:06d}-{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                archive.writestr(zipfile.ZipInfo(f"{n:08d}_{'' if i is None else i}.png"), encode_png((text or "").encode()))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return materialise(arrow_map(source, run, "path string, n_members long, n_bytes long"), "media-manifest")


class ByteRanges(InputPartition):
    """(path, start, end) of each range."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class _Window(io.RawIOBase):
    """The archive's tail as a seekable file, so that its directory is read without the rest."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def seekable(self):
        return True

    def readable(self):
        return True

    def seek(self, offset, whence=0):
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self):
        return self.at

    def read(self, n=-1):
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        data = self.file.read_at(n, self.at)
        self.at += len(data)
        return data


def _below(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives at or below a path."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    info = fs.get_file_info(name)
    found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(name, recursive=True))
    prefix = path[: len(path) - len(name)]
    return [(prefix + f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(".zip")]


def _listed(manifest: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives in a manifest (a folder of Parquet files), without a look at the archives."""
    fs, name = pyarrow.fs.FileSystem.from_uri(manifest)
    table = pyarrow.dataset.dataset(name, filesystem=fs, format="parquet").to_table(["path", "n_bytes"])
    return sorted(zip(table["path"].to_pylist(), table["n_bytes"].to_pylist()))


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], manifest: str | None, range_bytes: int):
        self.paths, self.manifest, self.range_bytes = paths, manifest, range_bytes

    def partitions(self):
        archives = _listed(self.manifest) if self.manifest else [a for p in self.paths for a in _below(p)]
        ranges = [(path, lo, min(size, lo + self.range_bytes)) for path, size in archives for lo in range(0, size, self.range_bytes)]
        each = max(1, -(-len(ranges) // MOST_PARTITIONS))
        return [ByteRanges(ranges[i : i + each]) for i in range(0, len(ranges), each)] or [ByteRanges([])]

    def read(self, partition):
        for path, start, end in partition.ranges:
            yield from self.read_range(path, start, end)

    def read_range(self, path: str, start: int, end: int):
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as f:
            members = sorted(((m.header_offset, m.file_size, m.CRC, m.filename) for m in zipfile.ZipFile(_Window(f, f.size())).infolist() if start <= m.header_offset < end))
            lo = 0
            while lo < len(members):
                hi, begin = lo + 1, members[lo][0]
                while hi < len(members) and members[hi][0] + members[hi][1] - begin <= RUN_BYTES:
                    hi += 1
                last = members[hi - 1]
                try:
                    run = f.read_at(last[0] + 30 + len(last[3].encode()) + last[1] + 64 - begin, begin)
                except OSError:
                    run = b""
                rows = [(n, self.member(f, run, begin, at, size, crc)) for at, size, crc, n in members[lo:hi]]
                names, media = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([n.split("_", 1)[1][:-4] or None for n in names], pa.string()), pa.array(names, pa.string()), pa.array(media, pa.binary())], ["id", "member", "media"])
                lo = hi

    @staticmethod
    def member(f, run: bytes, begin: int, at: int, size: int, crc: int) -> bytes:
        """A member's bytes from the run of bytes, or, if they are damaged, read again by the member's own offset."""
        for attempt in range(ATTEMPTS + 1):
            try:
                head = f.read_at(30, at) if attempt else run[at - begin : at - begin + 30]
                if len(head) == 30 and head[:4] == b"PK\x03\x04":
                    skip = 30 + sum(struct.unpack_from("<HH", head, 26))
                    data = f.read_at(size, at + skip) if attempt else run[at - begin + skip : at - begin + skip + size]
                    if len(data) == size and zlib.crc32(data) == crc:
                        return data
            except OSError:
                pass
        raise OSError(f"member at {at} can't be read")


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").option("paths", "uri\\nuri").load()``, or with ``manifest``: id, member, media."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "id string, member string, media binary"

    def reader(self, schema):
        paths = [p for p in (self.options.get("paths") or self.options.get("path") or "").split("\n") if p]
        return ArchiveReader(paths, self.options.get("manifest"), int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark, folder: str | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """All members of the archives below a folder, or of those in a manifest of ``write_archives``."""
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format("media_archive")
    return (reader.option("manifest", manifest.scratch_folder) if manifest is not None else reader.option("paths", folder)).load()


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text as an image, reads the images back, and returns their digests and features.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature.  Equal texts have equal values; empty and null texts are 64 zero bytes.
    """
    media = read_archives(docs.sparkSession, manifest=write_archives(docs))

    def run(batches):
        for batch in batches:
            out = []
            for m in batch["media"].to_pylist():
                samples, n = decode_png(m)
                out.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(samples)))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    digests = arrow_map(media, run, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return digests.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *digests.columns[1:])

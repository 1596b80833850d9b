"""Media columns: texts as 8-bit sound members of archives, and a data source that reads archives by byte range.

``write_archives`` packs WAV members (unsigned 8-bit samples, mono) into ZIP archives (each member deflated by itself)
in a shared folder: one archive a task attempt, rolled over at ``roll_bytes``, renamed into place when whole, so a lost task leaves nothing that
is read. The returned table lists the archives of successful attempts; only those are read.

``ArchiveSource`` (format ``media_archive``) plans partitions of ``split_bytes`` over the archives' sizes without opening
them. A partition reads the directory at an archive's end, takes the members whose header starts in its range, and streams
them as Arrow batches of bounded bytes. A member that fails its checks is read again by its own offset, up to ``retries``
times, without touching its neighbours; then the task fails, and Spark runs it anew.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftloom.llm.arrow import tidy
from siftloom.session import materialize, new_path

UNIT = 576
RATE = 8000
LEVEL = 1  # of the archives' lossless compression
LOCAL_HEADER = 30  # bytes of a ZIP member's header before its name


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text (null: empty) filled with bytes 255 to a positive multiple of 576, and their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * ((-len(data)) % UNIT or (0 if data else UNIT)), len(data)


def to_wav(samples: bytes) -> bytes:
    """A canonical WAV file: 44 bytes of header, unsigned 8-bit mono samples, and a zero byte if their number is odd."""
    pad = len(samples) & 1
    return (
        struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
        + samples
        + b"\0" * pad
    )


def from_wav(data: bytes) -> bytes:
    """Samples of a WAV file as ``to_wav`` writes it; walks the chunks and raises ValueError on anything else."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"fmt " and struct.unpack_from("<HH8xHH", data, at + 8)[::3] != (1, 8):
            raise ValueError("not 8-bit samples")
        if name == b"data":
            if at + 8 + n > len(data):
                raise ValueError("cut short")
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


def feature_of(samples: bytes) -> str:
    """A perceptual hash of the samples: 64 block means against their median, as 16 hex digits."""
    a = np.frombuffer(samples, np.uint8)
    edges = np.arange(65) * len(a) // 64
    sums = np.concatenate([[0], np.cumsum(a, dtype=np.int64)])
    means = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(edges[1:] - edges[:-1], 1)
    return np.packbits(means > np.median(means)).tobytes().hex()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Out:
    """An archive being written under a name of its own, renamed when it is closed."""

    def __init__(self, folder: str):
        self.fs, path = _open(folder)
        self.fs.create_dir(path, recursive=True)
        self.path = f"{path}/{uuid.uuid4().hex}.zip"
        self.uri = f"{folder.rstrip('/')}/{self.path.rpartition('/')[2]}"
        self.raw = self.fs.open_output_stream(self.path + ".part")
        self.zip, self.n, self.bytes = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED), 0, 0

    def add(self, key: int | None, n_bytes: int, data: bytes) -> None:
        info = zipfile.ZipInfo(f"{self.n:09d}.wav")
        info.comment = struct.pack("<?qQ", key is None, key or 0, n_bytes)
        info.compress_type, info.compress_level = zipfile.ZIP_DEFLATED, LEVEL
        with self.zip.open(info, "w", force_zip64=True) as f:
            f.write(data)
        self.n, self.bytes = self.n + 1, self.raw.tell()

    def close(self) -> tuple[str, int, int]:
        self.zip.close()
        size = self.raw.tell()
        self.raw.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri, size, self.n


def write_archives(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", roll_bytes: int = 64 << 20) -> DataFrame:
    """Store each text as a WAV member. Returns the stored table of archives: archive, size, members.

    Null text is the empty text, null keys are kept as such, repeated rows give repeated members, an empty table gives no
    archive. Columns other than ``key`` and ``text`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                out = out or _Out(folder)
                data, n = payload_of(t.as_py())
                out.add(k.as_py(), n, to_wav(data))
                if out.bytes >= roll_bytes:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        for row in done:
            yield pa.RecordBatch.from_pylist([dict(zip(("archive", "size", "members"), row, strict=True))])

    return materialize(df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(tidy(run), "archive string, size long, members long"), "archives")


class _Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class _In:
    """A seekable file for zipfile over an Arrow file."""

    def __init__(self, f):
        self.f = f

    def __getattr__(self, name):
        return getattr(self.f, name)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.listed, self.table = options.get("path"), options.get("archives"), options.get("table")
        self.split_bytes = int(options.get("split_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[_Range]:
        if self.table is not None:  # read here, on the driver: no task gets the list
            fs, path = _open(self.table)
            rows = dataset(path, filesystem=fs, format="parquet").to_table(columns=["archive", "size"])
            files = sorted(zip(rows.column("archive").to_pylist(), rows.column("size").to_pylist(), strict=True))
        elif self.listed is not None:
            files = [x.rsplit("\t", 1) for x in self.listed.split("\n") if x]
        else:
            fs, path = _open(self.folder)
            scheme = self.folder.partition("://")[0] + "://" if "://" in self.folder else "file://"
            files = [(scheme + i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.path.endswith(".zip")]
        return [_Range(uri, at, at + self.split_bytes) for uri, size in files for at in range(0, int(size), self.split_bytes)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, path = _open(partition.archive)
        with fs.open_input_file(path) as f, zipfile.ZipFile(_In(f)) as z:
            held, size = [], 0
            for info in z.infolist():
                if not partition.start <= info.header_offset < partition.end:
                    continue
                data = self.member(fs, path, f, info)
                null, key, n_bytes = struct.unpack("<?qQ", info.comment)
                held.append((None if null else key, partition.archive, info.header_offset, n_bytes, data))
                size += len(data)
                if size >= self.batch_bytes:
                    yield self.batch(held)
                    held, size = [], 0
            if held:
                yield self.batch(held)

    def member(self, fs, path: str, f, info: zipfile.ZipInfo) -> bytes:
        """A member's bytes by its own offset; every failed try opens the file anew and reads this member alone."""
        for tried in range(self.retries + 1):
            try:
                g = f if not tried else fs.open_input_file(path)
                g.seek(info.header_offset)
                head = g.read(LOCAL_HEADER)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member header")
                name, extra = struct.unpack_from("<HH", head, 26)
                g.seek(info.header_offset + LOCAL_HEADER + name + extra)
                data = g.read(info.compress_size)
                if info.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompress(data, -15)
                if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise OSError("member is damaged")
                return data
            except (OSError, zlib.error) as e:
                if tried == self.retries:
                    raise OSError(f"{path} at {info.header_offset}: {e}") from e
                time.sleep(0.05 * 2**tried)
        raise AssertionError

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "archive", "offset", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive")``: a folder (load path), the option ``table`` (a stored Parquet table of archive and
    size), or the option ``archives`` (lines of name, tab, size)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key long, archive string, offset long, n_bytes long, media binary"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_archives(spark: SparkSession, archives: DataFrame, **options) -> DataFrame:
    """Members of the listed archives. Only the place of the stored list goes into the plan; planning reads it (a short row for
    each archive of 64 MB), and each task gets its own archive and byte range."""
    spark.dataSource.register(ArchiveSource)
    if getattr(archives, "_siftloom_path", None) is None:
        archives = materialize(archives.select("archive", "size"), "archives")
    return spark.read.format("media_archive").options(table=archives._siftloom_path, **options).load()


def features(members: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read the samples back and describe them: the digest columns of the stored payload and a 64-bit perceptual hash."""
    schema = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for media in b.column("media"):
                data = media.as_buffer()
                raw = data.to_pybytes()
                s = from_wav(raw)
                out.append((len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(s)))
            if out:
                n, sha, crc, size, own, feat = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(own), pa.array(feat)],
                    names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return members.select("key", "n_bytes", "media").mapInArrow(tidy(run), schema).withColumnRenamed("key", key)


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every whole text in archives of the shared folder, read them back by byte range, and describe the samples."""
    spark = df.sparkSession
    archives = write_archives(df, new_path(spark, "media"), key, text)
    return features(read_archives(spark, archives), key)

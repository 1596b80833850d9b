"""Data sources over large files: ``image_blocks``, fixed blocks planned by byte range, and ``image_fragments``, partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftloom.functions.disks import fragments

COLUMNS = "path string, pos long, byte_offset long, size int, md5 string, is_full boolean, data binary"


def open_file(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def files_below(uri: str) -> list[tuple[str, int]]:
    """URI and size of a file, or of every file below a folder, in order."""
    store, path = open_file(uri)
    scheme = uri.partition("://")[0] + "://" if "://" in uri else ""
    info = store.get_file_info(path)
    found = [info] if info.is_file else [i for i in store.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file]
    return sorted((scheme + i.path, i.size) for i in found)


class _Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block = int(options.get("block_size", 4096))
        self.offset = int(options.get("offset", 0))
        self.length = int(options["length"]) if "length" in options else None
        self.split = max(1, int(options.get("split_bytes", 64 << 20)) // self.block) * self.block
        self.with_data = options.get("with_data", "false").lower() == "true"

    def partitions(self) -> list[_Range]:
        out = []
        for uri, size in files_below(self.path):
            end = size if self.length is None else min(size, self.offset + self.length)
            out += [_Range(uri, s, min(s + self.split, end)) for s in range(self.offset, end, self.split)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        store, path = open_file(part.uri)
        names = ["path", "pos", "byte_offset", "size", "md5", "is_full", "data"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.binary()]
        with store.open_input_file(path) as f:
            f.seek(part.start)
            at, held = part.start, []
            while at < part.end:
                data = f.read(min(self.block, part.end - at))
                if not data:
                    break
                held.append((part.uri, (at - self.offset) // self.block, at, len(data), hashlib.md5(data).hexdigest(), len(data) == self.block, data if self.with_data else None))
                at += len(data)
                if len(held) * self.block >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


class ImageBlocks(DataSource):
    """Options: path, block_size, offset, length (bytes), split_bytes, with_data."""

    @classmethod
    def name(cls) -> str:
        return "image_blocks"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


class _FragmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.compat = options.get("compat", "true").lower() == "true"
        self.whole_gpt = options.get("whole_gpt", "false").lower() == "true"

    def partitions(self) -> list[_Range]:
        return [_Range(uri, 0, size) for uri, size in files_below(self.path)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.uri:
            return
        store, path = open_file(part.uri)
        with store.open_input_file(path) as f:

            def at(offset: int, n: int) -> bytes:
                f.seek(min(offset, part.end))
                return f.read(n)

            found = fragments(part.end, at, vdi=part.uri.lower().endswith(".vdi"), compat=self.compat, whole_gpt=self.whole_gpt)
            for i, (offset, sectors, signature, kind) in enumerate(found):
                yield part.uri, i, offset, sectors, signature, kind


class ImageFragments(DataSource):
    """Fragments of every image at ``path``, from its boot records alone: a few sectors of an image are read, whatever its size.

    Options: path (a file or a folder), compat, whole_gpt as in ``siftloom.functions.disks.fragments``. One task an image.
    """

    @classmethod
    def name(cls) -> str:
        return "image_fragments"

    def schema(self) -> str:
        return "path string, infile_nb int, offset long, sectors long, signature int, type int"

    def reader(self, schema) -> _FragmentReader:
        return _FragmentReader(dict(self.options))

"""Binary descriptors of images and fragments: codec, source ``image_descr`` and sink."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed little-endian packed layouts.
HEADER = struct.Struct("<IiQ256s256siII")
FRAGMENT = struct.Struct("<IIQQII16s256s256s256s256s")
IMAGE_FIELDS = ("img_unique_nb", "img_type", "img_size", "img_name", "img_path", "disk_type", "fragment_nums", "boot_sector_offset")
FRAGMENT_FIELDS = ("fragment_unique_nb", "fragment_infile_nb", "fragment_offset", "fragment_size", "boot_signature", "fragment_type", "simhash", "fragment_name", "fragment_path", "src_path_name", "fragment_file_info_path")
FRAGMENT_DDL = "fragment_unique_nb long, fragment_infile_nb long, fragment_offset long, fragment_size long, boot_signature long, fragment_type int, simhash binary, fragment_name string, fragment_path string, src_path_name string, fragment_file_info_path string"
DDL = f"path string, img_unique_nb long, img_type int, img_size long, img_name string, img_path string, disk_type int, fragment_nums long, boot_sector_offset long, fragments array<struct<{FRAGMENT_DDL.replace(' ', ':').replace(',:', ',')}>>"


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def decode(data: bytes) -> tuple[dict, list[dict]]:
    head = dict(zip(IMAGE_FIELDS, HEADER.unpack_from(data), strict=True))
    rows = [dict(zip(FRAGMENT_FIELDS, FRAGMENT.unpack_from(data, HEADER.size + i * FRAGMENT.size), strict=True)) for i in range(head["fragment_nums"])]
    for row in (head, *rows):
        row.update({k: _text(v) for k, v in row.items() if isinstance(v, bytes) and k != "simhash"})
    return head, rows


def encode(head: dict, rows: list[dict]) -> bytes:
    raw = lambda fields, row: [v.encode() if isinstance(v := row[f], str) else v for f in fields]
    return HEADER.pack(*raw(IMAGE_FIELDS, head | {"fragment_nums": len(rows)})) + b"".join(FRAGMENT.pack(*raw(FRAGMENT_FIELDS, r)) for r in rows)


def with_simhash(data: bytes, n: int, simhash: bytes) -> bytes:
    """A descriptor with the n-th fragment's simhash replaced."""
    at = HEADER.size + n * FRAGMENT.size + struct.calcsize("<IIQQII")
    return data[:at] + simhash + data[at + 16 :]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ``*.descr`` below ``path``, with its fragments as an array."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.descr").option("recursiveFileLookup", "true").load(path)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"], strict=True):
                head, frags = decode(bytes(content))
                rows.append({"path": p} | head | {"fragments": frags})
            yield pd.DataFrame(rows, columns=["path", *IMAGE_FIELDS, "fragments"])

    return files.select("path", "content").mapInPandas(run, DDL)


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return read_images(spark, path).select(*[c for c in IMAGE_FIELDS], F.explode("fragments").alias("f")).select(*IMAGE_FIELDS, "f.*")


def write(images: DataFrame, folder: str) -> None:
    """One descriptor file for each row of ``read_images``'s schema, named by img_name."""

    def run(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for r in rows:
            d = r.asDict(recursive=True)
            data = encode(d, [x | {"simhash": bytes(x["simhash"] or b"\0" * 16)} for x in d["fragments"]])
            with store.open_output_stream(f"{base}/{d['img_name'].rpartition('/')[2]}.descr") as out:
                out.write(data)

    images.foreachPartition(run)


def pretty(data: bytes) -> str:
    head, rows = decode(data)
    lines = [f"{k}: {v}" for k, v in head.items()]
    for r in rows:
        lines.append("  " + ", ".join(f"{k}={v.hex() if isinstance(v, bytes) else v}" for k, v in r.items()))
    return "\n".join(lines)

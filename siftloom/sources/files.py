"""Smaller sources and sinks: digest lists, digest sidecars, memory logs, file trees, dedup packages."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed layout of a package: header, unique blocks, then a header, path, ids and tail for each file.
PACKAGE_MAGIC = 0x1329149
PACKAGE_HEADER = struct.Struct("<IIIII4xQ")
FILE_HEADER = struct.Struct("<IIIIi")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One digest or number a line."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("value"))


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def digests_of_sidecar(files: DataFrame) -> DataFrame:
    """path, pos, md5 from ``binaryFile`` rows of 16-byte digests."""
    n = F.floor(F.octet_length("content") / 16).cast("int")
    return files.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos")).select("path", "pos", F.lower(F.hex(F.substring(F.col("content"), F.col("pos") * 16 + 1, F.lit(16)))).alias("md5"))


def sidecar(md5s: list[str]) -> bytes:
    return b"".join(bytes.fromhex(m) for m in md5s)


def rss_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """time and rss_mb (field 7 of ten, KB / 1024) of memory samples; other lines are left out."""
    parts = F.split(F.col(value), " ")
    return lines.where(F.size(parts) >= 10).select(parts[0].alias("time"), (F.try_element_at(parts, F.lit(8)).cast("double") / 1024).alias("rss_mb"))


def read_rss_log(spark: SparkSession, path: str) -> DataFrame:
    return rss_log(spark.read.text(path))


def file_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, content and md5 of all files below a folder (files under 2 GB; larger ones by ``image_blocks``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), F.md5("content").alias("md5"), "content")


def pack(files: list[tuple], block: int = 4096) -> bytes:
    """A package of files (path, data, and mode or 0o644): unique full blocks once, and for each file its block ids and tail."""
    ids: dict[bytes, int] = {}
    meta = []
    for name, data, *mode in files:
        full = len(data) // block
        own = [ids.setdefault(data[i * block : (i + 1) * block], len(ids)) for i in range(full)]
        tail, path = data[full * block :], name.encode()
        size = FILE_HEADER.size + len(path) + 4 * len(own) + len(tail)
        meta.append(FILE_HEADER.pack(len(path), len(own), size, len(tail), *(mode or [0o644])) + path + struct.pack(f"<{len(own)}I", *own) + tail)
    unique = b"".join(ids)
    return PACKAGE_HEADER.pack(PACKAGE_MAGIC, block, len(files), len(ids), sum(len(f[1]) // block for f in files), PACKAGE_HEADER.size + len(unique)) + unique + b"".join(meta)


def unpack(data: bytes) -> list[tuple[str, bytes]]:
    return [(name, body) for name, body, _ in entries(data)]


def entries(data: bytes) -> list[tuple[str, bytes, int]]:
    """Path, bytes and mode of every file of a package."""
    magic, block, n, _, _, at = PACKAGE_HEADER.unpack_from(data)
    if magic != PACKAGE_MAGIC:
        raise ValueError("not a package")
    out = []
    for _ in range(n):
        name, ids, size, tail, mode = FILE_HEADER.unpack_from(data, at)
        p = at + FILE_HEADER.size
        own = struct.unpack_from(f"<{ids}I", data, p + name)
        body = b"".join(data[PACKAGE_HEADER.size + i * block : PACKAGE_HEADER.size + (i + 1) * block] for i in own)
        end = p + name + 4 * ids
        out.append((data[p : p + name].decode(), body + data[end : end + tail], mode))
        at += size
    return out


def packages(files: DataFrame, by: str = "package", block: int = 4096) -> DataFrame:
    """``by`` and content: one package of the files (path, data, mode) of each value of ``by``, in the order of their paths.

    A package is one binary value and so holds less than 2 GB; null data counts as empty.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("path")
        rows = [(p, bytes(d or b""), int(m)) for p, d, m in zip(pdf["path"], pdf["data"], pdf["mode"], strict=True)]
        return pd.DataFrame({by: pdf[by].iloc[:1], "content": [pack(rows, block)]})

    one = files.select(by, "path", "data", F.coalesce("mode", F.lit(0o644)).alias("mode"))
    return one.groupBy(by).applyInPandas(run, f"{by} {files.schema[by].dataType.simpleString()}, content binary")


def unpacked(packs: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, path, mode and data of every file of packages held as binary values."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.slice(i, 1)
                found = entries(held.column("__content")[0].as_py())
                kept = [pa.array(held.column(k).to_pylist() * len(found), held.schema.field(k).type) for k in keep]
                new = [pa.array([f[j] for f in found], t) for j, t in ((0, pa.string()), (2, pa.int32()), (1, pa.binary()))]
                yield pa.RecordBatch.from_arrays(kept + new, names=[*keep, "path", "mode", "data"])

    kinds = "".join(f"`{k}` {packs.schema[k].dataType.simpleString()}, " for k in keep)
    return packs.where(F.col(content).isNotNull()).select(*keep, F.col(content).alias("__content")).mapInArrow(run, kinds + "path string, mode int, data binary")


def extract(files: DataFrame, folder: str) -> None:
    """Write files (path, mode, data) below ``folder``, which all executors share, with their directories and modes.

    A path that would leave the folder is an error. A repeated task writes the same files again.
    """

    def run(rows) -> None:
        import os

        top = os.path.realpath(folder.removeprefix("file://"))
        for r in rows:
            to = os.path.realpath(os.path.join(top, r.path.lstrip("/")))
            if not to.startswith(top + os.sep):
                raise ValueError(f"{r.path} is outside of the folder")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "wb") as f:
                f.write(r.data or b"")
            os.chmod(to, r.mode & 0o7777)

    files.select("path", "mode", "data").foreachPartition(run)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; nulls are written, so that every object has every field."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects by a stated schema: nothing is inferred, and a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cluster_map(fragments: DataFrame, name: str = "name", cluster: str = "cluster") -> DataFrame:
    """name and dedup_map_json, the file that lists the fragment's cluster."""
    return fragments.select(F.col(name).alias("name"), F.concat(F.lit("cluster-"), F.col(cluster).cast("string"), F.lit(".json")).alias("dedup_map_json"))


def write_store(base: DataFrame, recipes: DataFrame, tails: DataFrame, folder: str, cluster: str = "cluster") -> None:
    """The store's three tables, partitioned by cluster."""
    for name, df in (("store_blocks", base), ("recipes", recipes), ("tails", tails)):
        df.write.mode("overwrite").partitionBy(cluster).parquet(f"{folder}/{name}")


def read_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{n}") for n in ("store_blocks", "recipes", "tails"))


def write_images(fragments: DataFrame, folder: str) -> None:
    """Write image, byte_offset, data rows below ``folder``, a URI that all executors share; gaps are filled with zeros.

    One image to a task, fragments in order, so that no image is held whole. Fragments that overlap are an error.
    """

    def run(rows) -> None:
        from itertools import groupby

        from siftloom.sources.images import open_file

        for image, own in groupby(rows, key=lambda r: r.image):
            store, path = open_file(f"{folder}/{image}")
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as out:
                for r in own:
                    gap = r.byte_offset - out.tell()
                    if gap < 0:
                        raise ValueError(f"fragments of {image} overlap at {r.byte_offset}")
                    while gap > 0:
                        gap -= out.write(bytes(min(gap, 1 << 20)))
                    out.write(r.data)

    fragments.select("image", "byte_offset", "data").repartition("image").sortWithinPartitions("image", "byte_offset").foreachPartition(run)

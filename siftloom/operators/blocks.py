"""Fixed-size blocks of binary objects, their digests, and block statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.digests import blank_digest, composite_digest
from siftloom.operators.numbering import numbered


def fixed_blocks(df: DataFrame, size: int, data: str = "bytes", keep: tuple[str, ...] = (), with_data: bool = False) -> DataFrame:
    """``keep`` columns, pos, byte_offset, size, md5, is_full (and data) of every block of every object.

    The last block may be short (the tail). Null and empty objects have no blocks. It is a map: nothing is shuffled.
    """
    n = F.octet_length(data)
    some = df.where(n > 0).select(*keep, F.col(data).alias("__b"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size).cast("long"))).alias("pos"))
    part = F.substring(F.col("__b"), (F.col("pos") * size + 1).cast("int"), F.lit(size))
    out = some.select(*keep, "pos", (F.col("pos") * size).alias("byte_offset"), part.alias("data"))
    cols = [*keep, "pos", "byte_offset", F.octet_length("data").alias("size"), F.md5("data").alias("md5"), (F.octet_length("data") == size).alias("is_full")]
    return out.select(*cols, *(["data"] if with_data else []))


def drop_blank(blocks: DataFrame, size: int) -> DataFrame:
    return blocks.where(F.col("md5") != blank_digest(size))


def layout(df: DataFrame, size: int, data: str = "bytes", keep: tuple[str, ...] = ()) -> DataFrame:
    """block_num, has_last_block, last_block_offset (-1 without tail) and last_block_size of each object."""
    n = F.coalesce(F.octet_length(data), F.lit(0))
    tail = F.pmod(n, F.lit(size))
    return df.select(*keep, F.floor(n / size).cast("long").alias("block_num"), (tail > 0).cast("int").alias("has_last_block"), F.when(tail > 0, n - tail).otherwise(-1).cast("long").alias("last_block_offset"), tail.cast("int").alias("last_block_size"))


def digest_counts(blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return blocks.groupBy(*by, "md5").agg(F.count("*").alias("n"))


def top_blocks(blocks: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent digests, ties by digest."""
    return digest_counts(blocks).orderBy(F.desc("n"), "md5").limit(k)


def count_histogram(blocks: DataFrame) -> DataFrame:
    """How many digests occur how often."""
    return digest_counts(blocks).groupBy("n").agg(F.count("*").alias("digests"))


def unique_blocks(blocks: DataFrame) -> DataFrame:
    return digest_counts(blocks).where("n = 1").select("md5")


def dup_stats(blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total and distinct blocks and dup_rate = (total - distinct) / total, by two-level counts."""
    per = blocks.groupBy(*by, "md5").agg(F.count("*").alias("n"))
    out = per.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_blocks"), F.count("*").alias("unique_blocks"))
    return out.withColumn("dup_rate", F.round((F.col("total_blocks") - F.col("unique_blocks")) / F.col("total_blocks"), 6))


def composite(df: DataFrame, size: int, data: str = "bytes", keep: tuple[str, ...] = ()) -> DataFrame:
    """The composite digest of each object, in one pass and without a shuffle."""
    b, n = F.coalesce(F.col(data), F.lit(b"")), F.coalesce(F.octet_length(data), F.lit(0))
    block = lambda i: F.md5(F.substring(F.col("__b"), (i * size + 1).cast("int"), F.lit(size)))
    every = F.transform(F.sequence(F.lit(0), F.floor(F.col("__n") / size).cast("int")), block)
    return df.select(*keep, b.alias("__b"), n.alias("__n")).select(*keep, composite_digest(every).alias("digest"))


def compare_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions at which two block lists differ; only positions that are full blocks on both sides."""
    left = a.where("is_full").select("pos", F.col("md5").alias("md5_a"))
    right = b.where("is_full").select("pos", F.col("md5").alias("md5_b"))
    return left.join(right, "pos").where("md5_a <> md5_b")


def sectors(bytes_: Column, size: int = 512) -> Column:
    return F.ceil(bytes_ / size).cast("long")


def every_kth(blocks: DataFrame, k: int = 10) -> DataFrame:
    """md5: the first, (k + 1)-th ... of the distinct digests in order."""
    return numbered(blocks.select("md5").distinct(), ["md5"], "nth").where(F.col("nth") % k == 0).select("md5")


def find_blocks(blocks: DataFrame, md5s: DataFrame) -> DataFrame:
    """All blocks whose digest is in ``md5s``, with their places; repeats in ``md5s`` change nothing."""
    return blocks.join(md5s.select("md5").distinct(), "md5", "left_semi")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in an order that depends on ``key`` and ``seed`` alone, so that reruns and other layouts agree."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)

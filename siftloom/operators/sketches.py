"""128-bit SimHash of block digests, and MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1
MAX = (1 << 31) - 1


def log_weight(n: Column) -> Column:
    """11 + floor(log2 n), exactly."""
    return 10 + F.length(F.bin(n))


def count_weight(size: int) -> Callable[[Column], Column]:
    return lambda n: n * size


WEIGHTS: dict[str, Callable[[Column], Column]] = {"log": log_weight, "one": lambda n: F.lit(1).cast("long"), "count": lambda n: n, "count4096": count_weight(4096), "power": lambda n: F.floor(F.pow(n, F.lit(0.7)))}


def simhash128(features: DataFrame, by: tuple[str, ...], weight: str = "weight", digest: str = "md5", whole: bool = False) -> DataFrame:
    """``by`` and simhash (32 hex digits): bit i is set if the signed weights of the digests' bits i sum above zero.

    Each partition is sorted by object and summed in Arrow functions, then the sums (1 KB an object and partition) are
    combined. ``whole``: each object's rows lie in one partition, so there is nothing to combine.
    """
    keys = ", ".join(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in by)
    base = features.where(F.col(digest).isNotNull()).select(*by, F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("__w"), F.unhex(F.substring(digest, 1, 32)).alias("__d"))
    if whole:
        return base.sortWithinPartitions(*by).mapInArrow(_summed(by, _weighted, _digits), f"{keys}, simhash string")
    sums = base.sortWithinPartitions(*by).mapInArrow(_summed(by, _weighted, _packed), f"{keys}, __s binary")
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sums.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_summed(by, _unpacked, _digits), f"{keys}, simhash string")


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    """A row of ``size`` bytes for each value of a binary column."""
    fixed = column.cast(pa.binary(size))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * size : (fixed.offset + len(fixed)) * size].reshape(-1, size)


def _weighted(b: pa.RecordBatch) -> np.ndarray:
    """The weights of a digest's set bits, and its weight."""
    w = b.column("__w").to_numpy()[:, None]
    return np.concatenate([np.unpackbits(_bytes(b.column("__d"), 16), axis=1) * w, w], axis=1)


def _packed(sums: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in sums], pa.binary())


def _unpacked(b: pa.RecordBatch) -> np.ndarray:
    return _bytes(b.column("__s"), 129 * 8).view(np.int64)


def _digits(sums: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes().hex() for v in np.packbits(2 * sums[:, :128] > sums[:, 128:], axis=1)])


def _summed(by: tuple[str, ...], read: Callable, write: Callable, rows: int = 2048):
    """Rows sorted by ``by`` -> one row for each run of equal ``by``: ``write`` of the sums of what ``read`` gives."""

    def differ(a: pa.RecordBatch, b: pa.RecordBatch) -> np.ndarray:
        each = [pc.coalesce(pc.not_equal(a.column(c), b.column(c)), pc.xor(pc.is_null(a.column(c)), pc.is_null(b.column(c)))) for c in by]
        return np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in each])

    def out(b: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in by), write(sums)], names=[*by, "out"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                starts = np.r_[0, np.flatnonzero(differ(b.slice(1), b.slice(0, b.num_rows - 1))) + 1]
                sums = np.add.reduceat(read(b), starts, axis=0)
                if last is not None:
                    if differ(key, b.slice(0, 1))[0]:
                        yield out(key, last[None])
                    else:
                        sums[0] += last
                if len(starts) > 1:
                    yield out(b.take(pa.array(starts[:-1])), sums[:-1])
                key, last = b.slice(int(starts[-1]), 1), sums[-1]
        if last is not None:
            yield out(key, last[None])

    return run


def block_simhash(blocks: DataFrame, by: tuple[str, ...], weight: str = "log", everyone: DataFrame | None = None) -> DataFrame:
    """SimHash of each object's distinct digests, weighted by their counts. ``everyone`` adds objects without features."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = blocks.select(*by, "md5").repartition(n, *by).groupBy(*by, "md5").agg(F.count("*").alias("n"))
    got = simhash128(counted.withColumn("weight", WEIGHTS[weight](F.col("n"))), by, whole=True)
    if everyone is None:
        return got
    return everyone.select(*by).distinct().join(got, list(by), "left").select(*by, F.coalesce("simhash", F.lit("0" * 32)).alias("simhash"))


def permutations(n: int, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of n hash functions, from one legacy random stream, so that n only cuts it off."""
    rng = np.random.RandomState(seed)
    return [(int(rng.randint(1, PRIME, dtype=np.uint64)), int(rng.randint(0, PRIME, dtype=np.uint64))) for _ in range(n)]


def signature(items: list[str] | set[str], perms: list[tuple[int, int]]) -> np.ndarray:
    """Least permuted value of the items' hashes (first four bytes of SHA-1, little-endian); 2^31 - 1 for no items."""
    out = np.full(len(perms), MAX, np.uint64)
    if items:
        hv = np.array([int.from_bytes(hashlib.sha1(i.encode()).digest()[:4], "little") for i in items], np.uint64)
        a, b = np.array(perms, np.uint64).T
        with np.errstate(over="ignore"):
            for s in range(0, len(hv), 4096):
                values = ((a[:, None] * hv[None, s : s + 4096] + b[:, None]) % np.uint64(PRIME)) & np.uint64(MAX)
                out = np.minimum(out, values.min(axis=1))
    return out


def minhash(n: int = 128, seed: int = 1) -> Callable[[Column], Column]:
    """A function of an array of strings that gives its signature, array<long>."""
    perms = permutations(n, seed)

    @F.pandas_udf("array<long>")
    def run(items: pd.Series) -> pd.Series:
        return items.map(lambda v: None if v is None else signature([x for x in v if x is not None], perms).astype(np.int64))

    return run


def jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures of one length."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def cardinality(sig: Column) -> Column:
    """Estimated number of distinct items: n / sum(value / max) - 1."""
    total = F.aggregate(sig, F.lit(0.0), lambda acc, v: acc + v / F.lit(float(MAX)))
    return F.size(sig) / total - 1


def merge(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def is_empty(sig: Column) -> Column:
    return F.forall(sig, lambda v: v == MAX)


def union(df: DataFrame, by: tuple[str, ...], sig: str = "sig") -> DataFrame:
    """Merged signature of each group: a minimum by position, combined before the shuffle."""
    return df.select(*by, F.posexplode(sig).alias("i", "v")).groupBy(*by, "i").agg(F.min("v").alias("v")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(sig))

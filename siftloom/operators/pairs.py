"""Pairs of objects by Hamming distance, Dice and Jaccard similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftloom.functions.digests import halves
from siftloom.operators.sketches import jaccard
from siftloom.session import materialize

#: Rows of a chunk of digests: at most (24 bytes each in a task that compares two chunks), and at least where there are as many.
CHUNK, LEAST = 1 << 18, 1 << 12
#: Digests that one digest is compared with at a time, so that what is between stays in a core's cache.
STRIP = 1 << 15


def hamming_pairs(df: DataFrame, eps: int | None, key: str = "id", digest: str = "simhash") -> DataFrame:
    """a < b and distance of all pairs of digests at most ``eps`` bits apart (None: every pair).

    With eps + 1 bands of at least ten bits, two digests within eps agree on a band, so the join is an equi-join on bands
    in which a pair is taken at its first common band. For wider eps bands are too short to select, and all pairs are
    compared, chunk by chunk in Arrow functions.
    """
    if eps is not None and eps + 1 > 12:
        return _chunk_pairs(df, eps, key, digest)
    hi, lo = halves(F.col(digest))
    one = df.select(F.col(key).alias("a"), hi.alias("ah"), lo.alias("al"))
    two = df.select(F.col(key).alias("b"), hi.alias("bh"), lo.alias("bl"))
    dist = (F.bit_count(F.col("ah").bitwiseXOR(F.col("bh"))) + F.bit_count(F.col("al").bitwiseXOR(F.col("bl")))).cast("int")
    if eps is not None:
        edges = [128 * i // (eps + 1) for i in range(eps + 2)]
        cut = lambda h, l: F.array(*[F.substring(F.concat(F.lpad(F.bin(F.col(h)), 64, "0"), F.lpad(F.bin(F.col(l)), 64, "0")), s + 1, e - s) for s, e in zip(edges[:-1], edges[1:], strict=True)])
        one = one.withColumn("ab", cut("ah", "al")).select("*", F.posexplode("ab").alias("i", "band"))
        two = two.withColumn("bb", cut("bh", "bl")).select("*", F.posexplode("bb").alias("i", "band"))
        first = F.array_position(F.zip_with("ab", "bb", lambda x, y: x == y), True) == F.col("i") + 1
        joined = one.join(two, ["i", "band"]).where((F.col("a") < F.col("b")) & first)
    else:
        joined = one.join(two, F.col("a") < F.col("b"))
    out = joined.select("a", "b", dist.alias("distance"))
    return out if eps is None else out.where(F.col("distance") <= eps)


def _chunk_pairs(df: DataFrame, eps: int, key: str, digest: str) -> DataFrame:
    """``hamming_pairs`` of all pairs: the rows are dealt out to g chunks, and each pair of chunks is a group of its own.

    A row is sent g times. g follows the number of rows, so that a group fits in a task and there are groups for all tasks.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    hi, lo = halves(F.col(digest))
    rows = materialize(df.where(F.col(key).isNotNull() & F.col(digest).isNotNull()).select(F.col(key).alias("k"), hi.alias("h"), lo.alias("l")), "digests")
    n, tasks = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = max(math.ceil(n / CHUNK), min(math.ceil(n / LEAST), math.ceil(math.sqrt(8 * tasks)), 32), 1)
    dealt = rows.withColumn("c", F.pmod(F.xxhash64("k"), F.lit(g))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    i, j = F.least("c", "o"), F.greatest("c", "o")
    # pair (i, j) of chunks, i <= j, is group j (j + 1) / 2 + i; side 0 is chunk i
    groups = dealt.select((F.shiftright(j * (j + 1), 1) + i).alias("group"), (F.col("c") != i).cast("int").alias("side"), (i == j).alias("own"), "k", "h", "l")
    placed = groups.repartition(min(g * (g + 1) // 2, max(tasks, 528)), "group").sortWithinPartitions("group", "side")
    return placed.mapInArrow(_near(eps, to_arrow_type(kind)), f"a {kind.simpleString()}, b {kind.simpleString()}, distance int")


def _near(eps: int, kind: pa.DataType):
    """Rows (group, side, own, k, h, l) sorted by group and side -> pairs within ``eps`` of the two sides of each group, or of
    one chunk (``own``) with itself."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, last = [], None
        for b in batches:
            v = b.column("group").to_numpy()
            edges = np.r_[0, np.flatnonzero(v[1:] != v[:-1]) + 1, len(v)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e > s:
                    if held and v[s] != last:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(b.slice(s, e - s))
                    last = v[s]
        if held:
            yield pa.Table.from_batches(held)

    def pairs(keys: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        x, y, d = (np.concatenate(v) for v in zip(*found, strict=True))
        one, two = keys.take(pa.array(x)), keys.take(pa.array(y))
        less = pc.less(one, two)
        out = pa.RecordBatch.from_arrays([pc.if_else(less, one, two), pc.if_else(less, two, one), pa.array(d.astype(np.int32))], names=["a", "b", "distance"])
        return out.filter(pc.not_equal(one, two))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            keys = pa.concat_arrays(t.column("k").cast(kind).chunks)
            h, l = (np.ascontiguousarray(t.column(c).to_numpy()).view(np.uint64) for c in ("h", "l"))
            own = t.column("own")[0].as_py()
            cut = 0 if own else int(np.searchsorted(t.column("side").to_numpy(), 1))
            x, count, found, size = np.empty(STRIP, np.uint64), np.empty(STRIP, np.uint8), [], 0
            for s in range(cut, len(h), STRIP):
                e = min(s + STRIP, len(h))
                for r in range(e if own else cut):
                    start = max(s, r + 1) if own else s
                    m = e - start
                    near = np.flatnonzero(np.bitwise_count(np.bitwise_xor(h[start:e], h[r], out=x[:m]), out=count[:m]) <= eps)
                    if len(near):
                        d = count[near] + np.bitwise_count(l[start + near] ^ l[r])
                        hit = d <= eps
                        if hit.any():
                            found.append((np.full(int(hit.sum()), r), start + near[hit], d[hit]))
                            size += len(found[-1][0])
                    if size > 100_000:
                        yield pairs(keys, found)
                        found, size = [], 0
            if found:
                yield pairs(keys, found)

    return run


def set_pairs(sets: DataFrame, key: str = "id", item: str = "md5") -> DataFrame:
    """a < b, common, size_a, size_b of all pairs of sets that share an item, by an inverted index."""
    s = sets.select(F.col(key).alias("id"), F.col(item).alias("item")).distinct()
    sizes = s.groupBy("id").agg(F.count("*").alias("n"))
    pairs = s.withColumnRenamed("id", "a").join(s.withColumnRenamed("id", "b"), "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    return pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("size_a")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("size_b")), "b")


def dice_pairs(sets: DataFrame, key: str = "id", item: str = "md5") -> DataFrame:
    return set_pairs(sets, key, item).select("a", "b", F.round(2 * F.col("common") / (F.col("size_a") + F.col("size_b")), 6).alias("dice"))


def jaccard_pairs(sets: DataFrame, key: str = "id", item: str = "md5") -> DataFrame:
    return set_pairs(sets, key, item).select("a", "b", F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6).alias("jaccard"))


def signature_pairs(sigs: DataFrame, key: str = "id", sig: str = "sig") -> DataFrame:
    """a < b and the estimated Jaccard similarity of all pairs that agree in some position."""
    each = sigs.select(F.col(key).alias("k"), F.posexplode(sig).alias("i", "v"))
    hits = each.select(F.col("k").alias("a"), "i", "v").join(each.select(F.col("k").alias("b"), "i", "v"), ["i", "v"]).where("a < b")
    n = sigs.select(F.max(F.size(sig)).alias("n"))
    return hits.groupBy("a", "b").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("a", "b", F.round(F.col("c") / F.col("n"), 6).alias("jaccard"))


__all__ = ["dice_pairs", "hamming_pairs", "jaccard", "jaccard_pairs", "set_pairs", "signature_pairs"]

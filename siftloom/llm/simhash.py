"""SimHash near-duplicates: fingerprints of whole texts, linked within a Hamming radius by bit-sliced comparison.

Distinct fingerprints meet in buckets: 64 bits are cut into ``radius + 2`` blocks, and each pair of blocks is a key, so any
two fingerprints within the radius agree on two whole blocks and meet at least once. Inside a bucket the fingerprints are
compared by bit planes: plane i holds bit i of 64 fingerprints a word, a few carry-save counters add up the differing bits
of 64 pairs at a time, and a block of pairs is abandoned once all its counters have passed the radius. A bucket hands on
only a spanning forest of its links. Buckets of more than ``chunk`` fingerprints are dealt out as pairs of chunks.

Texts of a Jaccard similarity of 0.8 differ in about 15 bits in 100, too many for a radius of whole blocks. ``similar`` links
them by longer fingerprints (``sketch``: 512 bits over the distinct five-word shingles): the share of equal bits estimates the
similarity, and texts meet where one of ``BANDS`` samples of 16 bits agrees (0.95 of pairs at a similarity of 0.8, 0.99 at 0.9),
to be compared by the same bit planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrow import per_row, runs, starts, texts, tidy
from siftloom.llm.text import hashes, mix, spans, words
from siftloom.operators.components import components
from siftloom.session import discard, materialize, maybe_broadcast

BITS = 64
CHUNK = 4096
SLICE = 1 << 16
WORDS = tuple(f"f{i}" for i in range(8))  # of a sketch
BANDS, BAND_BITS = 40, 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles (repeats count; fewer words: the whole sequence; none: 0).

    A bit is set if it is set in over half the shingles' XXH64 values.
    """
    w = words(text)
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = map(join, zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else iter([join(w)])
    n, total = max(len(w) - k + 1, 1), np.zeros(BITS, np.int64)
    for start in range(0, n, SLICE):
        h = np.fromiter((digest(s, seed) for s, _ in zip(shingles, range(min(SLICE, n - start)), strict=False)), np.uint64, min(SLICE, n - start))
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = 3, seed: int = 42) -> DataFrame:
    """``keep`` columns and fp, the fingerprint's bits as a signed long. ``keep`` columns must be long."""
    schema = pa.schema([*[(c, pa.int64()) for c in keep], ("fp", pa.int64())])

    def one(value: str | None) -> tuple[int]:
        f = fingerprint(value, k, seed)
        return (f - (1 << 64) if f >> 63 else f,)

    source = df.select(*[F.col(c).cast("long").alias(c) for c in keep], F.col(text).alias("__text"))
    return texts(source).mapInArrow(tidy(per_row(one, schema, "__text", keep=keep)), ", ".join(f"{c} long" for c in (*keep, "fp")))


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes (64 or more, ceil(n / 64)) of n unsigned words, or rows of words: bit j of word w in plane i is bit i of value 64 w + j."""
    values = values.reshape(len(values), -1)
    full = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), np.uint64)
    full[: len(values)] = values
    bits = np.unpackbits(full.astype("<u8").view(np.uint8).reshape(len(full), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(diff: Callable[[int], np.ndarray], shape: tuple[int, ...], radius: int, bits: int = BITS) -> np.ndarray:
    """Words whose bit is set where at most ``radius`` of ``bits`` planes of differing bits are set.

    ``diff(i)`` is plane i. Two planes at a time enter carry-save counters of as many bits as the radius needs; what runs
    over them stays in ``over``. After every eight planes a block in which all pairs are over is abandoned.
    """
    size = max(radius.bit_length(), 1)
    counter = [np.zeros(shape, np.uint64) for _ in range(size)]
    over = np.zeros(shape, np.uint64)
    for i in range(0, bits, 2):
        x, y, low = diff(i), diff(i + 1), counter[0]
        half = x ^ y
        carry = (x & y) | (low & half)
        counter[0] = low ^ half
        for k in range(1, size):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if i % 8 == 6 and (over == ALL).all():
            return np.zeros(shape, np.uint64)
    # the counters hold 0 .. 2^size - 1: those above the radius are over too
    same = np.full(shape, ALL)
    for k in reversed(range(size)):
        if radius >> k & 1:
            same &= counter[k]
        else:
            over |= same & counter[k]
            same &= ~counter[k]
    return ~over


def close_rows(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix (len(x), len(y)): which fingerprints (words, or rows of words) of x and y are within the radius."""
    planes, out = planes_of(y), np.zeros((len(x), len(y)), bool)
    x = x.reshape(len(x), -1)
    step = max(1, (1 << 15) // planes.shape[1])
    for s in range(0, len(x), step):
        part = x[s : s + step]

        def diff(i: int, part=part) -> np.ndarray:
            return planes[i][None, :] ^ np.where(part[:, i // BITS] >> np.uint64(i % BITS) & np.uint64(1), ALL, np.uint64(0))[:, None]

        got = within(diff, (len(part), planes.shape[1]), radius, len(planes))
        out[s : s + step] = np.unpackbits(got.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(y)]
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (x[i], y[i]) are within the radius, 64 pairs a word."""
    planes = planes_of(x ^ y)
    got = within(lambda i: planes[i], (planes.shape[1],), radius, len(planes))
    return np.unpackbits(got.astype("<u8").view(np.uint8), bitorder="little")[: len(x)].astype(bool)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest linked index of each of n nodes under the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spread(links: np.ndarray) -> np.ndarray:
    """Labels of len(x) + len(y) nodes under a boolean matrix of links between x and y, without listing the links."""
    n, m = links.shape
    label = np.arange(n + m)
    far = n + m
    while True:
        new = label.copy()
        for s in range(0, n, 512):
            e = min(s + 512, n)
            new[s:e] = np.minimum(new[s:e], np.where(links[s:e], label[None, n:], far).min(axis=1, initial=far))
        low = np.full(m, far)
        for s in range(0, n, 512):
            e = min(s + 512, n)
            low = np.minimum(low, np.where(links[s:e], new[s:e, None], far).min(axis=0, initial=far))
        new[n:] = np.minimum(new[n:], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _edges(radius: int, words: tuple[str, ...] = (), small: int = 16) -> Callable:
    """Arrow function over rows (bucket, chunk_x, chunk_y, side, fp) sorted by the first three: a forest for each group.

    fp is the fingerprint; with ``words``, these columns are, and fp is its number.
    """
    batch = (1 << 20) // max(1, len(words)) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["bucket", "cx", "cy"]):
            fp = table.column("fp").to_numpy().view(np.uint64)
            value = np.stack([table.column(c).to_numpy().view(np.uint64) for c in words], axis=1) if words else fp
            side = table.column("side").to_numpy()
            at = starts(table, ["bucket", "cx", "cy"])
            size = np.diff(np.append(at, len(fp)))
            a, b = [], []
            for n in range(2, small + 1):  # all small buckets of one size at a time
                first = at[size == n]
                if len(first):
                    pi, pj = np.triu_indices(n, 1)
                    for s in range(0, len(first), max(1, batch // len(pi))):
                        f = first[s : s + max(1, batch // len(pi))]
                        i, j = (f[:, None] + pi).ravel(), (f[:, None] + pj).ravel()
                        ok = close_pairs(value[i], value[j], radius) & (fp[i] != fp[j])
                        if ok.any():
                            i, j = i[ok], j[ok]
                            used, idx = np.unique(np.concatenate([i, j]), return_inverse=True)
                            label = forest(idx[: len(i)], idx[len(i) :], len(used))
                            own = label != np.arange(len(used))
                            a.append(fp[used[own]])
                            b.append(fp[used[label[own]]])
            for s, n in zip(at[size > small], size[size > small], strict=True):
                rows, d = np.arange(s, s + n), side[s : s + n]
                x, y = (rows, rows) if (d == 0).all() else (rows[d == 1], rows[d == 2])
                if len(x) and len(y):
                    both = fp[np.concatenate([x, y])]
                    label = spread(close_rows(value[x], value[y], radius))
                    own = both[label] != both
                    a.append(both[own])
                    b.append(both[label[own]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return run


def _met(keyed: DataFrame, radius: int, chunk: int, words: tuple[str, ...] = (), small: int = 16) -> DataFrame:
    """Links a, b of the rows (bucket, fp, and ``words``, if any) that meet in a bucket."""
    spark = keyed.sparkSession
    hot = materialize(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("c")), "hot")
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    # every row of a hot bucket meets each chunk once: as x against the chunks after its own, as y against those up to it
    turns = F.when(F.col("c").isNull(), F.array(F.struct(F.lit(0).alias("cx"), F.lit(0).alias("cy"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.coalesce("c", F.lit(1)) - 1),
            lambda o: F.struct(F.least(o, F.col("own")).alias("cx"), F.greatest(o, F.col("own")).alias("cy"), F.when(o == F.col("own"), 0).when(F.col("own") < o, 1).otherwise(2).alias("side")),
        )
    )
    dealt = keyed.join(maybe_broadcast(hot), "bucket", "left").withColumn("own", own).select("bucket", "fp", *words, F.explode(turns).alias("t")).select("bucket", "t.cx", "t.cy", "t.side", "fp", *words)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "bucket", "cx", "cy").sortWithinPartitions("bucket", "cx", "cy")
    return sorted_.mapInArrow(tidy(_edges(radius, words, small)), "a long, b long").distinct()


def links(fps: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Links a, b that connect distinct fingerprints (column fp) exactly as all pairs within the radius do."""
    blocks = radius + 2
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", edge[i]).bitwiseAND((1 << (edge[i + 1] - edge[i])) - 1) for i in range(blocks)]
    # bucket: the numbers of the two blocks above their bits
    keys = [
        F.lit(n << 56).bitwiseOR(F.shiftleft(part[i], edge[j + 1] - edge[j])).bitwiseOR(part[j])
        for n, (i, j) in enumerate(combinations(range(blocks), 2))
    ]
    return _met(fps.select("fp", F.explode(F.array(*keys)).alias("bucket")), radius, chunk)


def groups(fps: DataFrame, radius: int = 3, key: str = "doc_id", chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep``, fp, component_id (the smallest key of the fingerprints reachable over links, itself included)
    and root (the component's smallest fingerprint).

    ``fps`` holds key and fp and is read several times: pass a stored table. Copies share a fingerprint and so a component.
    Null keys count as no key: they get the component's smallest other key, or null. Repeated rows stay repeated.
    """
    first = materialize(fps.groupBy("fp").agg(F.min(key).alias("first")), "fps")
    comp = components(links(first, radius, chunk))
    rooted = materialize(first.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    low = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "low")
    of = materialize(rooted.join(low, "root").select("fp", "component_id", "root"), "component")
    return fps.join(of, "fp").select(key, *keep, "fp", "component_id", "root")


def sketch(text: str | None, k: int = 5) -> np.ndarray:
    """A SimHash of 512 bits of the distinct k-word shingles (fewer words: the whole sequence; none: 0)."""
    code = hashes(text)
    if not len(code):
        return np.zeros(len(WORDS), np.uint64)
    first = np.arange(max(len(code) - k + 1, 1))
    h = np.unique(spans(mix(code))(first, np.minimum(first + k, len(code))))
    total = np.zeros(BITS * len(WORDS), np.int64)
    for s in range(0, len(h), SLICE // 8):
        part = h[s : s + SLICE // 8]
        wide = np.stack([mix(part * np.uint64(0x9E3779B97F4A7C15 + 2 * j) + np.uint64(j)) for j in range(len(WORDS))], axis=1)
        total += np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(total * 2 > len(h), bitorder="little").view("<u8")


def sketches(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = 5) -> DataFrame:
    """``keep`` columns (long) and the words f0 .. f7 of each text's ``sketch`` as signed longs."""
    schema = pa.schema([(c, pa.int64()) for c in (*keep, *WORDS)])
    source = df.select(*[F.col(c).cast("long").alias(c) for c in keep], F.col(text).alias("__text"))
    return texts(source).mapInArrow(tidy(per_row(lambda t: sketch(t, k).view(np.int64).tolist(), schema, "__text", keep=keep)), ", ".join(f"{c} long" for c in (*keep, *WORDS)))


def estimated_radius(similarity: float) -> int:
    """Differing bits of 512 that texts of this Jaccard similarity have on average (sets of equal size), less 0.4 of a deviation.

    Texts well below it then seldom pass: of those at 0.8 about a third are missed, at 0.85 few, at 0.9 none.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = BITS * len(WORDS)
    return int(n * share - 0.4 * np.sqrt(n * share * (1 - share)))


def _bands(bands: int, bits: int, seed: int = 6):
    place = np.stack([np.random.RandomState(seed + b).choice(BITS * len(WORDS), bits, replace=False) for b in range(bands)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(s, 2000) for s in range(0, whole.num_rows, 2000)):
                value = np.stack([b.column(c).to_numpy() for c in WORDS], axis=1)
                bit = np.unpackbits(value.astype("<i8").view(np.uint8), axis=1, bitorder="little")
                code = (bit[:, place].astype(np.int64) << np.arange(bits)).sum(axis=2) + (np.arange(bands, dtype=np.int64) << 32)
                at = np.repeat(np.arange(len(value)), bands)
                yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), pa.array(b.column("fp").to_numpy()[at]), *(pa.array(value[at, j]) for j in range(len(WORDS)))], names=["bucket", "fp", *WORDS])

    return run


def similar(sketched: DataFrame, similarity: float = 0.8, key: str = "doc_id", chunk: int = CHUNK, keep: tuple[str, ...] = (), bands: int = BANDS, bits: int = BAND_BITS) -> DataFrame:
    """``key``, ``keep``, component_id (the smallest key reachable) and root for rows of ``sketches``.

    Two rows are linked if they meet in a band and differ in at most ``estimated_radius`` bits: an estimate of a Jaccard
    similarity of ``similarity`` or more. ``sketched`` is read several times: pass a stored table. Texts without words link
    with each other. Null keys count as no key; repeated rows stay repeated.
    """
    first = sketched.groupBy(*WORDS).agg(F.min(key).alias("first"))
    first = materialize(first.withColumn("fp", F.monotonically_increasing_id()), "sketches")
    keyed = materialize(first.select("fp", *WORDS).mapInArrow(tidy(_bands(bands, bits)), f"bucket long, fp long, {', '.join(f'{c} long' for c in WORDS)}"), "bands")
    comp = components(_met(keyed, estimated_radius(similarity), chunk, WORDS, 64))
    rooted = materialize(first.join(comp, F.col("fp") == F.col("node"), "left").select(*WORDS, "first", F.coalesce("root", "fp").alias("root")), "roots")
    discard(keyed)
    low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(rooted.join(low, "root").select(*WORDS, "component_id", "root"), "component")
    return sketched.join(of, list(WORDS)).select(key, *keep, "component_id", "root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, k: int = 3, seed: int = 42) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id for every row. See ``fingerprint`` and ``groups``.

    Null, empty and blank texts have fingerprint zero and link like any other. An empty table gives no rows.
    """
    fps = materialize(fingerprints(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), k=k, seed=seed), "fingerprints")
    g = groups(fps, radius)
    return g.select(F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are at a squared distance of at most 2 - 2c. After a fixed rotation they are cut into blocks
of ``block`` dimensions; if the whole distance is within the budget, some block's is within its share (its dimensions' part
of the budget). Each block is range-joined:

1. Sort: the vectors of a label go in order of their cells in the block's coordinates (a coarse grid of all of them, then a
   finer one), are dealt out by range, and every ``chunk`` rows in order are packed into one row with their bounding box.
   No vector is copied within a block, and a hot label or cell is only more chunks.
2. Range join of boxes: chunks meet in grid cells over the block's first two coordinates, each pair in one cell, and stay
   a pair if their boxes are within the block's radius.
3. Compare: a chunk is held while the chunks it meets stream past it. Block distances select candidates; the union of the
   blocks' candidates is verified exactly, each by the first block that admits it, so nothing is counted twice. Only link
   counts and a spanning forest of the links leave a task, no list of pairs.

Rotated coordinates travel as integers of 2**-24, so which block admits a pair does not depend on rounding in a task, and a
whole distance is known to within ``margin``. The few pairs closer than that to the threshold are decided by the cosine of
the vectors themselves in double precision, which the others need not be: their cosine is on the same side.

Copies (equal label and components) are joined beforehand and count by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrow import texts, tidy
from siftloom.llm.simhash import forest
from siftloom.operators.components import components
from siftloom.session import materialize, maybe_broadcast

BLOCK = 8
CHUNK = 2048
SCALE = float(1 << 24)
PLACE = ["label", "dim", "part"]
PARTNERS = 32  # chunks that stream past one copy of a chunk


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def margin(dim: int) -> float:
    """Bound of what rounding to 2**-24 moves the squared distance of two vectors that are at most 2 apart."""
    return 8 * np.sqrt(dim) / SCALE


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, embedding -> vec_id, label, dim, vector (doubles as bytes); null vector where it links with nothing."""
    for b in batches:
        dims, vecs = [], []
        for e, lab, vid in zip(b.column(2), b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
            raw = e.values if e.is_valid and lab is not None and vid is not None else None
            ok = raw is not None and len(raw) > 0 and raw.null_count == 0
            if ok:
                w = raw.to_numpy() + 0.0
                ok = bool(np.isfinite(w).all()) and np.abs(w).max() > 0
            dims.append(len(w) if ok else None)
            vecs.append(w.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "label", "dim", "vector"])


def scaled(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors divided by their largest component, so that no square overflows."""
    v = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    return v / np.abs(v).max(axis=1, keepdims=True)


def _edges(dim: int, block: int) -> np.ndarray:
    n = max(1, dim // block)
    return np.array([dim * i // n for i in range(n + 1)])


def _budget(threshold: float, dim: int) -> float:
    return 2 - 2 * threshold + margin(dim)


def _blocks(threshold: float, block: int):
    """gid, label, dim, mult, vector -> a row for each block: its cells (coarse, then fine) and the rotated integers."""
    names = ["label", "dim", "part", "path", "gid", "mult", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for whole in batches:
            for b in (whole.slice(s, 500) for s in range(0, whole.num_rows, 500)):
                dims = b.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    rows = b.take(pa.array(np.flatnonzero(dims == d)))
                    v = scaled(rows.column("vector").to_pylist(), d)
                    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                    turn = turns.setdefault(d, rotation(d))
                    q = np.rint(v @ turn.T * SCALE).astype(np.int32)
                    packed = pa.array([x.tobytes() for x in q], pa.binary())
                    edges = _edges(d, block)
                    for p, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        radius = np.sqrt(_budget(threshold, d) * (hi - lo) / d)
                        x = q[:, lo:hi] / SCALE
                        path = np.clip(np.floor(np.hstack([x / (4 * radius), x / radius])) + 128, 0, 255).astype(np.uint8)
                        n = len(q)
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("label"), rows.column("dim"), pa.array(np.full(n, p, np.int32)), pa.array([y.tobytes() for y in path], pa.binary()), rows.column("gid"), rows.column("mult"), packed],
                            names=names,
                        )

    return run


def _pack(threshold: float, block: int, chunk: int):
    """Rows sorted by PLACE and path -> a row for every ``chunk`` of them: box, grid cells, and the rows as bytes.

    own: codes of the grid cells (first two coordinates) that the box touches; wide: those that it touches when it is
    widened by the radius; o0, o1, w0, w1: their least coordinates.
    """
    fields = [("label", pa.string()), ("dim", pa.int32()), ("part", pa.int32()), ("cid", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("share", pa.float64()), ("own", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("o0", pa.int64()), ("o1", pa.int64()), ("w0", pa.int64()), ("w1", pa.int64()), ("gids", pa.binary()), ("mults", pa.binary()), ("qs", pa.binary())]
    schema = pa.schema(fields)

    def cells(lo: np.ndarray, hi: np.ndarray, by: float, width: float) -> tuple[list[int], int, int]:
        low, high = np.floor((lo[:2] - by) / width).astype(int).tolist(), np.floor((hi[:2] + by) / width).astype(int).tolist()
        low, high = (low + [0])[:2], (high + [0])[:2]
        return [(a << 32) + b for a in range(low[0], high[0] + 1) for b in range(low[1], high[1] + 1)], low[0], low[1]

    def row(place: tuple, gid: list, mult: list, q: list) -> pa.RecordBatch:
        label, d, p = place
        edges = _edges(d, block)
        share = _budget(threshold, d) * (edges[p + 1] - edges[p]) / d
        radius = np.sqrt(share)
        x = np.frombuffer(b"".join(q), np.int32).reshape(-1, d)[:, edges[p] : edges[p + 1]] / SCALE
        lo, hi = x.min(axis=0), x.max(axis=0)
        own, o0, o1 = cells(lo, hi, 0.0, 4 * radius)
        wide, w0, w1 = cells(lo, hi, radius * (1 + 1e-9), 4 * radius)
        values = (label, d, p, gid[0], lo.tolist(), hi.tolist(), share, own, wide, o0, o1, w0, w1, np.array(gid, np.int64).tobytes(), np.array(mult, np.int64).tobytes(), b"".join(q))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, fields, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, gid, mult, q = None, [], [], []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in PLACE), strict=True))
            g, m, v = (b.column(c).to_pylist() for c in ("gid", "mult", "q"))
            for i, k in enumerate(keys):
                if gid and (k != place or len(gid) == chunk):
                    yield row(place, gid, mult, q)
                    gid, mult, q = [], [], []
                place = k
                gid.append(g[i])
                mult.append(m[i])
                q.append(v[i])
        if gid:
            yield row(place, gid, mult, q)

    return run, "label string, dim int, part int, cid long, lo array<double>, hi array<double>, share double, own array<long>, wide array<long>, o0 long, o1 long, w0 long, w1 long, gids binary, mults binary, qs binary"


class _Chunk:
    def __init__(self, gids: bytes, mults: bytes, qs: bytes, lo: int, hi: int):
        self.gid, self.mult = np.frombuffer(gids, np.int64), np.frombuffer(mults, np.int64)
        self.q = np.frombuffer(qs, np.int32).reshape(len(self.gid), -1)
        x = (self.q[:, lo:hi] / SCALE).astype(np.float32)
        half, one = -(x.astype(np.float64) ** 2).sum(axis=1, keepdims=True).astype(np.float32) / 2, np.ones((len(x), 1), np.float32)
        self.left, self.right = np.hstack([x, half, one]), np.hstack([x, one, half])


def _pairs(x: _Chunk, y: _Chunk, same: bool, p: int, edges: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index arrays i, j and squared distances of the pairs that block p admits and no block before it."""
    dim = int(edges[-1])
    share = budget * np.diff(edges) / dim
    limit = np.floor(share * SCALE**2).astype(np.int64)
    least = np.float32(-(share[p] + 1e-5) / 2)
    for s in range(0, len(x.gid), 512):
        i, j = np.nonzero(x.left[s : s + 512] @ y.right.T >= least)  # minus half the squared distance in the block
        i = i + s
        if same:
            i, j = i[j > i], j[j > i]
        for c in range(0, len(i), 20_000):
            a, b = i[c : c + 20_000], j[c : c + 20_000]
            gap = x.q[a].astype(np.int64) - y.q[b]
            by = np.add.reduceat(gap * gap, edges[:-1], axis=1)
            fits = by <= limit
            own = fits[:, p] & ~fits[:, :p].any(axis=1)
            yield a[own], b[own], by[own].sum(axis=1) / SCALE**2


def _compare(threshold: float, block: int):
    """Rows (PLACE, ax, slot, side, cid, gids, mults, qs): after each chunk (side 0) those that are compared with it (side 1).

    Gives rep, n, root, sure: links of ``rep`` (n) and an edge of the spanning forest, or (not sure) a pair to verify.
    """

    def batch(rep: np.ndarray, n: np.ndarray, root: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(root.astype(np.int64)), pa.array(np.full(len(rep), sure))], names=["rep", "n", "root", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, cid = None, None
        for b in batches:
            dims, parts, sides, cids = (b.column(c).to_pylist() for c in ("dim", "part", "side", "cid"))
            for r in range(b.num_rows):
                edges, p = _edges(dims[r], block), parts[r]
                here = _Chunk(*(b.column(c)[r].as_py() for c in ("gids", "mults", "qs")), edges[p], edges[p + 1])
                if sides[r] == 0:
                    x, cid = here, cids[r]
                    continue
                same, near = cids[r] == cid, margin(dims[r])
                gid = x.gid if same else np.concatenate([x.gid, here.gid])
                shift, far = (0 if same else len(x.gid)), 2 - 2 * threshold
                mx, count, tree = x.mult, np.zeros(len(gid)), [np.zeros((2, 0), np.int64)]
                for i, j, d in _pairs(x, here, same, p, edges, _budget(threshold, dims[r])):
                    unsure = np.abs(d - far) <= near
                    if unsure.any():
                        yield batch(x.gid[i[unsure]], np.zeros(int(unsure.sum())), here.gid[j[unsure]], False)
                    i, j = i[(d <= far) & ~unsure], j[(d <= far) & ~unsure]
                    if len(i):
                        count += np.bincount(i, here.mult[j], len(gid)) + np.bincount(j + shift, mx[i], len(gid))
                        used, at = np.unique(np.concatenate([i, j + shift]), return_inverse=True)
                        label = forest(at[: len(i)], at[len(i) :], len(used))
                        own = label != np.arange(len(used))
                        tree.append(np.stack([used[own], used[label[own]]]))
                hit = np.flatnonzero(count)
                if len(hit):
                    a, c = np.concatenate(tree, axis=1)
                    label = forest(a, c, len(gid))
                    other = np.flatnonzero(label != np.arange(len(gid)))
                    yield batch(np.concatenate([gid[hit], gid[other]]), np.concatenate([count[hit], np.zeros(len(other))]), np.concatenate([gid[hit], gid[label[other]]]), True)

    return run


def _verify(threshold: float):
    """Pairs rep, other with their vectors and numbers of copies: the links among them, as ``_compare`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                rows = b.take(pa.array(np.flatnonzero(dims == d)))
                v, w = scaled(rows.column("vx").to_pylist(), d), scaled(rows.column("vy").to_pylist(), d)
                ok = (v * w).sum(axis=1) / np.sqrt((v * v).sum(axis=1) * (w * w).sum(axis=1)) >= threshold
                x, y, mx, my = (rows.column(c).to_numpy()[ok] for c in ("rep", "other", "mx", "my"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in ((x, y), (my, mx), (np.minimum(x, y),) * 2)], names=["rep", "n", "root"])

    return run


def _meetings(meta: DataFrame) -> DataFrame:
    """PLACE, ax, cid: pairs of chunks whose boxes are within the block's radius, each once (ax <= cid)."""
    x = meta.select(*PLACE, F.col("cid").alias("ax"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"), "o0", "o1", F.explode("own").alias("cell"))
    y = meta.select(*PLACE, "cid", "lo", "hi", "share", "w0", "w1", F.explode("wide").alias("cell"))
    # of all cells that they share, the pair meets in the least
    code = F.greatest("o0", "w0") * F.lit(1 << 32) + F.greatest("o1", "w1")
    gap = F.zip_with(F.zip_with("lo", "xhi", lambda a, b: a - b), F.zip_with("xlo", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    far = F.aggregate(gap, F.lit(0.0), lambda t, v: t + v * v)
    return x.join(y, [*PLACE, "cell"]).where((F.col("ax") <= F.col("cid")) & (F.col("cell") == code) & (far <= F.col("share") + 1e-9)).select(*PLACE, "ax", "cid")


def near_duplicates(df: DataFrame, threshold: float = 0.98, key: str = "vec_id", label: str = "label", embedding: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``df``: vec_id, n_links, component_id, kept.

    n_links counts the other vectors (rows) of the same label with cosine >= ``threshold``; component_id is the smallest
    vec_id reachable. Vectors without label, null, empty, zero, of another length, or with null or non-finite components
    link with nothing; rows without key take no part either and get n_links 0, component_id null and kept false. Repeated
    rows are vectors of their own that link with their copies, and rows that share a key but not the vector are told apart.
    Labels of any type are compared as strings. Other columns are not read. An empty table gives no rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    base = base.mapInArrow(tidy(_parse), "vec_id long, label string, dim int, vector binary").withColumn("hash", F.md5("vector"))
    base = materialize(base, "vectors")
    # a vector of each label gets a number of its own, stored with it
    distinct = base.where("vector is not null").groupBy("label", "hash").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    distinct = materialize(distinct.withColumn("gid", F.monotonically_increasing_id()), "distinct")
    rows = distinct.select("gid", "label", "dim", "mult", "vector").mapInArrow(tidy(_blocks(threshold, block)), "label string, dim int, part int, path binary, gid long, mult long, q binary")
    pack, schema = _pack(threshold, block, chunk)
    order = [*PLACE, "path", "gid"]
    chunks = materialize(texts(rows).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(tidy(pack), schema), "chunks")
    plan = materialize(_meetings(chunks.drop("gids", "mults", "qs")), "meetings")
    slots = plan.groupBy(*PLACE, "ax").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("slots"))
    plan = materialize(plan.join(slots, [*PLACE, "ax"]).withColumn("slot", F.pmod(F.xxhash64("cid"), "slots").cast("int")).drop("slots"), "slots")
    sent = plan.select(*PLACE, "ax", "slot", F.lit(1).alias("side"), "cid").unionByName(plan.select(*PLACE, "ax", "slot", F.lit(0).alias("side"), F.col("ax").alias("cid")).distinct())
    dealt = chunks.select(*PLACE, "cid", "gids", "mults", "qs").join(maybe_broadcast(sent), [*PLACE, "cid"])
    group = [*PLACE, "ax", "slot"]
    found = texts(dealt).repartition(n, *group).sortWithinPartitions(*group, "side", "cid").mapInArrow(tidy(_compare(threshold, block)), "rep long, n long, root long, sure boolean")
    found = materialize(found, "found")
    vx = distinct.select(F.col("gid").alias("rep"), "dim", F.col("vector").alias("vx"), F.col("mult").alias("mx"))
    vy = distinct.select(F.col("gid").alias("other"), F.col("vector").alias("vy"), F.col("mult").alias("my"))
    close = found.where("not sure").select("rep", F.col("root").alias("other")).join(vx, "rep").join(vy, "other")
    verified = texts(close).mapInArrow(tidy(_verify(threshold)), "rep long, n long, root long")
    links = materialize(found.where("sure").drop("sure").unionByName(verified).groupBy("rep", "root").agg(F.sum("n").alias("n")), "links")
    comp = components(links.where("rep <> root"), "rep", "root")
    counts = links.groupBy(F.col("rep").alias("r")).agg(F.sum("n").alias("n"))
    known = distinct.select("gid", "label", "hash", "low", "mult").join(counts, F.col("gid") == F.col("r"), "left").join(comp, F.col("gid") == F.col("node"), "left")
    known = materialize(known.select("label", "hash", "low", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("root", "gid").alias("root")), "known")
    least = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(least, "root").select("label", "hash", "n", "component")
    out = base.select("vec_id", "label", "hash").join(known, ["label", "hash"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))

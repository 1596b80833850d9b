"""Mixing sources to target weights by balanced sampling with the cube method (Deville and Tille, 2004).

A source whose target is r times its size takes floor(r) whole copies of each document, and each document once more with
probability r - floor(r). Those fractional probabilities move through the null space of two balancing constraints, words
and documents, until few units are neither 0 nor 1: any three fractional units span a direction that changes neither total, and
a step along it fixes one of them. The flight runs in blocks of a source, then over what the blocks leave, block by block
again. Each block holds back a ladder of ``HELD`` units of falling size from the flight; with the two that the last flight
leaves they are the landing problem of a source, at most ``HELD`` + 2 units: of all their subsets it takes the one that comes
nearest to the words and documents that their probabilities ask for.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrow import runs, starts, tidy
from siftloom.llm.text import WORD_PATTERN
from siftloom.operators.numbering import numbered
from siftloom.session import materialize, maybe_broadcast

WEIGHTS = (5, 2, 1)
CAP = 3.0
BLOCK_ROWS = 2048
HELD = 12
EPS = 1e-9


def targets(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Targets min(cap x size, level x weight) that add up to ``total`` (or to all caps, if those are less)."""
    top = [cap * s for s in sizes]
    out, left, free = [0.0] * len(sizes), float(total), [i for i in range(len(sizes))]
    while free:
        share = sum(weights[i] for i in free)
        over = [i for i in free if share <= 0 or left * weights[i] / share > top[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / share
            return out
        for i in over:
            out[i] = top[i]
            left -= top[i]
        left = max(left, 0.0)
        free = [i for i in free if i not in set(over)]
    return out


class Flight:
    """The pool of at most two fractional units of one stream; units are (probability, size, row)."""

    def __init__(self, rng: random.Random):
        self.pool, self.rng = [], rng

    def add(self, p: float, size: float, row) -> list[tuple]:
        """Put a unit in; returns the (row, 0 or 1) that are decided now."""
        self.pool.append([p, size, row])
        return self._settle(self.step() if len(self.pool) > 2 else None)

    def _settle(self, _) -> list[tuple]:
        done = [(u[2], int(u[0] > 0.5)) for u in self.pool if not EPS < u[0] < 1 - EPS]
        self.pool = [u for u in self.pool if EPS < u[0] < 1 - EPS]
        return done

    def step(self) -> None:
        (pa_, a, _), (pb, b, _), (pc, c, _) = self.pool
        u = (c - b, a - c, b - a)
        if u == (0, 0, 0):
            u = (1, -1, 0)
        p = (pa_, pb, pc)
        up = min((1 - q) / x if x > 0 else -q / x for q, x in zip(p, u, strict=True) if x)
        down = min(q / x if x > 0 else (q - 1) / x for q, x in zip(p, u, strict=True) if x)
        by = up if self.rng.random() * (up + down) < down else -down
        for unit, x in zip(self.pool, u, strict=True):
            unit[0] += by * x


def ladder(sizes: list[float], held: int = HELD) -> set[int]:
    """Indexes of ``held`` units (all, if fewer): of falling size, each at most two thirds of the one before, then the smallest.

    ``sizes`` fall. Sums of subsets of such units come near any total below theirs.
    """
    out, want = [], float("inf")
    for i, v in enumerate(sizes):
        if v > 0 and v <= want and len(out) < held:
            out.append(i)
            want = v / 1.5
    picked = set(out)
    for i in reversed(range(len(sizes))):
        if len(picked) >= held:
            break
        if sizes[i] > 0:
            picked.add(i)
    return picked


def land(units: list) -> list[tuple]:
    """(row, 0 or 1) for units (probability, size, row): the subset nearest to the words, then to the documents, that they ask for."""
    if not units:
        return []
    p, size = np.array([u[0] for u in units]), np.array([u[1] for u in units], float)
    taken = np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1
    cost = np.abs(taken @ size - p @ size) + 0.01 * (size.mean() or 1) * np.abs(taken.sum(axis=1) - p.sum())
    best = taken[int(cost.argmin())]
    return [(u[2], int(v)) for u, v in zip(units, best, strict=True)]


def _fly(seed: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["rank", "block"]):
            p, size = table.column("p").to_pylist(), table.column("size").to_pylist()
            rank, block = table.column("rank").to_pylist(), table.column("block").to_pylist()
            at = starts(table, ["rank", "block"]).tolist() + [len(p)]
            now, pick = [0.0] * len(p), [None] * len(p)
            for s, e in zip(at[:-1], at[1:], strict=True):
                key = f"{seed}/{rank[s]}/{block[s]}/{last}"
                f = Flight(random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")))
                open_ = [i for i in range(s, e) if EPS < p[i] < 1 - EPS]  # by falling size
                kept = {open_[i] for i in ladder([size[i] for i in open_])}
                for i in range(s, e):
                    if i in kept:
                        continue
                    for row, v in f.add(p[i], size[i], i):
                        pick[row] = v
                left = f.pool + [[p[i], size[i], i] for i in sorted(kept)]
                for row, v in land(left) if last else ():
                    pick[row] = v
                for q, _, row in left:
                    now[row] = q
            table = table.drop_columns(["p", "pick"]).append_column("p", pa.array(now, pa.float64())).append_column("pick", pa.array(pick, pa.int32()))
            yield from table.combine_chunks().to_batches(max_chunksize=20_000)

    return run


FIELDS = "doc_id long, size long, rank long, source_size long, target double, copies int, h long, dup long, p double, pick int"


def _round(units: DataFrame, block, seed: int, last: bool) -> DataFrame:
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [f.split()[0] for f in FIELDS.split(", ")]
    dealt = units.withColumn("block", block).repartition(n, "rank", "block").sortWithinPartitions("rank", "block", F.desc("size"), "h", "doc_id", "dup", "p")
    return dealt.select(*cols[:-2], "block", *cols[-2:]).mapInArrow(tidy(_fly(seed, last)), ", ".join([*FIELDS.split(", ")[:-2], "block long", *FIELDS.split(", ")[-2:]])).drop("block")


def level(stats: DataFrame, cap: float) -> tuple[float, float]:
    """Words and weights that sources below their cap share, so that targets min(cap x size, words / weights x weight) add up to
    all words, from a stored table of source_size and weight. Each round caps more sources; totals alone reach the driver."""
    total = stats.agg(F.sum("source_size")).first()[0] or 0
    left, share, n = float(total), stats.agg(F.sum("weight")).first()[0] or 0.0, -1
    while share > 0:
        over = F.lit(left) * F.col("weight") / F.lit(share) > cap * F.col("source_size")
        row = stats.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("source_size"))).alias("size"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if row.n == n:
            break
        n, left, share = row.n, max(total - cap * (row["size"] or 0), 0.0), row.weight or 0.0
    return left, share


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of ``df``: doc_id, size, source_size, target, taken, copies, and source_rank.

    Sources by code point, null last, get ``weights`` in turn, and share all words; a source's target stops at ``cap``
    times its size, and the excess goes to the others by weight. ``taken`` is size x copies; copies is the floor or the
    ceiling of target / source size. Texts without words (null ones too) have size 0 and take part in the balance of
    documents alone. Null and repeated keys are allowed: every row counts. An empty table gives no rows. The same rows
    give the same mix, however they are partitioned. Any number of sources is allowed. Inclusion probabilities hold up to
    the landing: the at most ``HELD`` + 2 last units of a source go where they bring its words nearest to the target. Other
    columns are not read.
    """
    base = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    base = materialize(base, "sizes")
    stats = numbered(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    stats = materialize(stats.withColumn("weight", weight), "sources")
    left, share = level(stats, cap)
    top, even = cap * F.col("source_size"), F.lit(left) * F.col("weight") / F.lit(share)
    goal = F.when(F.lit(share) > 0, F.least(even, top)).otherwise(top)
    ratio = F.when(F.col("source_size") > 0, F.least(goal / F.col("source_size"), F.lit(cap))).otherwise(1.0)
    plan = materialize(stats.select("source", "rank", "source_size", goal.alias("target"), ratio.alias("ratio"), F.ceil(F.col("n") / block_rows).alias("blocks")), "plan")
    # rows that agree in all are told apart by a running number, so that nothing depends on partitions
    each = base.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")).select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("dup"))
    joined = each.alias("b").join(maybe_broadcast(plan).alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
    p = F.col("ratio") - F.floor("ratio")
    units = joined.select(
        "doc_id",
        "size",
        "rank",
        "source_size",
        "target",
        F.floor(F.col("ratio") + EPS).cast("int").alias("copies"),
        F.xxhash64(F.lit(seed), "doc_id", "size", "dup").alias("h"),
        "dup",
        F.when((p < EPS) | (p > 1 - EPS), 0.0).otherwise(p).alias("p"),
        F.lit(None).cast("int").alias("pick"),
        "blocks",
    )
    first = F.pmod("h", F.col("blocks"))
    parts, open_ = [], materialize(_round(units, first, seed, False), "flight")
    for turn in range(1, 50):
        parts.append(open_.where("pick is not null"))
        rest = open_.where("pick is null")
        most = rest.groupBy("rank").count().agg(F.max("count")).first()[0] or 0
        last = most <= block_rows
        block = F.lit(0).cast("long") if last else F.pmod(F.xxhash64(F.lit(turn), "h"), F.lit(-(-most * 2 // block_rows)))
        open_ = materialize(_round(rest, block, seed + turn, last), "flight")
        if last:
            break
    parts.append(open_)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.col("copies") + F.col("pick")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), F.col("rank").alias("source_rank"))

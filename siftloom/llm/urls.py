"""URL filters: prefix rules, and for the rest the ratio of two variable-order Markov models of characters.

One model is of accepted URLs, one of rejected ones (those that rules decide). A byte's probability after up to ``ORDER``
bytes is interpolated from the shortest context up to the longest that the model has seen, by Witten-Bell smoothing. The
score of a URL is the difference of its log-likelihoods by length, and the threshold is calibrated on scores that each fold
gets from the counts of the other folds.

Counts are taken over all URLs and grow with them: a gram (a byte and the ``ORDER`` bytes before it, as one long) and its
shorter forms are rows of stored tables, smoothed level by level by joins on the gram without its oldest byte. Scoring joins
the grams of the URLs with the table of the longest ones. Nothing of the models reaches the driver or is broadcast, but for
grams and URLs that each make up a ten-thousandth of all rows or more: there are at most ten thousand of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrow import runs, starts, texts, tidy
from siftloom.session import materialize

ORDER = 6  # a gram of 7 bytes fits into a long
FOLDS = 5
BINS = 4096
SCALE = 1 << 32  # log-likelihoods are summed as integers, so that their order does not matter
HOT = 10_000
#: (host suffix, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_and_path(url: str = "url") -> tuple:
    """Host and path as columns: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    u = F.col(url)
    at = F.when(u.isNull(), 0).otherwise(F.instr(u, "://"))
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(df: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (the longest that fits, by host then path; else null) and ruling (its verdict)."""
    host, path = host_and_path(url)
    df = df.withColumns({"host": host, "path": path})
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):  # the longest comes last, outermost
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, ruling = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(ruling)
    return df.withColumns({"rule": rule, "ruling": ruling})


def grams(url: bytes) -> np.ndarray:
    """The gram of each byte: itself and the ``ORDER`` bytes before it (zero before the start), the latest lowest."""
    flat = np.frombuffer(b"\0" * ORDER + url, np.uint8).astype(np.int64)
    out = np.zeros(len(url), np.int64)
    for o in range(ORDER + 1):
        out |= flat[ORDER - o : len(flat) - o] << (8 * o)
    return out


EVENTS = "uid long, gram long, k long, g int, m long"


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, url, g, m -> EVENTS: each gram of a URL and how often it has it (k)."""
    names, held, size = [f.split()[0] for f in EVENTS.split(", ")], [], 0

    def batch() -> pa.RecordBatch:
        uid, gram, k, g, m = zip(*held, strict=True)
        n = [len(x) for x in gram]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(uid, np.int64), n)), pa.array(np.concatenate(gram)), pa.array(np.concatenate(k)), pa.array(np.repeat(np.array(g, np.int32), n)), pa.array(np.repeat(np.array(m, np.int64), n))], names=names)

    for b in batches:
        for uid, url, g, m in zip(b.column("uid").to_pylist(), b.column("url"), b.column("g").to_pylist(), b.column("m").to_pylist(), strict=True):
            gram, k = np.unique(grams(url.as_py().encode("utf-8", "surrogatepass")), return_counts=True)
            held.append((uid, gram, k.astype(np.int64), g, m))
            size += len(gram)
            if size > 100_000:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


COUNTS = [f"c{i}" for i in range(2 * FOLDS)]  # of rejected URLs by fold, then of accepted ones
PAIRS = 2 * (FOLDS + 1)  # models: rejected without each fold and with all, then accepted


def _smooth(order: int):
    """Rows (ctx, gram, COUNTS, q) sorted by ctx -> gram, p: probabilities of the gram's byte in every model, from the counts of
    its context and the probabilities q in the context that is one byte shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["ctx"]):
            c = np.stack([t.column(x).to_numpy() for x in COUNTS], axis=1).astype(np.float64)
            n = np.concatenate([np.column_stack([c[:, s].sum(axis=1, keepdims=True) - c[:, s], c[:, s].sum(axis=1)]) for s in (slice(0, FOLDS), slice(FOLDS, None))], axis=1)
            q = t.column("q").combine_chunks().flatten().to_numpy().reshape(-1, PAIRS) if order else np.full((len(c), PAIRS), 1 / 256)
            at = starts(t, ["ctx"])
            size = np.diff(np.append(at, len(c)))
            total, kinds = (np.repeat(np.add.reduceat(v, at, axis=0), size, axis=0) for v in (n, (n > 0).astype(float)))
            p = np.where(total > 0, (n + kinds * q) / np.maximum(total + kinds, 1), q)
            yield pa.RecordBatch.from_arrays([t.column("gram").combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, PAIRS, dtype=np.int32)), pa.array(p.ravel()))], names=["gram", "p"])

    return run


def ratios(events: DataFrame) -> DataFrame:
    """gram, n (how many rows of ``events`` hold it) and r: the scaled log ratio of its byte for accepted and rejected URLs, by
    the models without each fold and by those of all. ``events`` is a stored table."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.col("k") * F.col("m")
    counted = events.groupBy("gram").agg(*[F.sum(F.when(F.col("g") == i, weight).otherwise(0)).alias(c) for i, c in enumerate(COUNTS)], F.count("*").alias("n"))
    levels = [materialize(counted, "grams")]
    for o in reversed(range(ORDER)):
        short = F.col("gram").bitwiseAND((1 << 8 * (o + 1)) - 1)
        levels.append(materialize(levels[-1].groupBy(short.alias("gram")).agg(*[F.sum(c).alias(c) for c in COUNTS]), "grams"))
    below = None
    for o, level in enumerate(reversed(levels)):
        rows = level.select(F.shiftrightunsigned("gram", 8).alias("ctx"), "gram", *COUNTS)
        if below is None:
            rows = rows.withColumn("q", F.lit(None).cast("array<double>"))
        else:
            lower = below.select(F.col("gram").alias("low"), F.col("p").alias("q"))
            rows = rows.join(lower, F.col("gram").bitwiseAND((1 << 8 * o) - 1) == F.col("low")).drop("low")
        rows = rows.repartition(n, "ctx").sortWithinPartitions("ctx", "gram")
        below = materialize(rows.mapInArrow(tidy(_smooth(o)), "gram long, p array<double>"), "smooth")
    r = F.array(*[F.round((F.log(F.col("p")[FOLDS + 1 + i]) - F.log(F.col("p")[i])) * SCALE).cast("long") for i in range(FOLDS + 1)])
    return below.join(levels[0].select("gram", "n"), "gram").select("gram", "n", r.alias("r"))


def _hot_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """``left`` joined with the stored ``right`` (unique ``key``; n: its rows in ``left``, ``total`` together). Keys of one row in HOT
    or more are at most HOT and are broadcast, so no key that is shuffled has more."""
    hot = right.where(F.col("n") * HOT >= total).drop("n")
    cold = right.where(F.col("n") * HOT < total).drop("n")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def scores(urls: DataFrame) -> tuple[DataFrame, float]:
    """(uid, score; threshold) for the stored ``urls``: uid, url, size (bytes), m (rows) and g (class x FOLDS + fold; -1: none).

    A score is the length-normalised difference of log-likelihoods by the models of all labelled URLs; an empty URL scores
    0. Each fold's URLs are scored by the counts of the other folds too, and the threshold is the middle of the bins of
    those scores with the greatest mean of the two classes' recalls. Without URLs of both kinds it is 0.
    """
    events = materialize(texts(urls.select("uid", "url", "g", "m")).mapInArrow(tidy(_events), EVENTS), "events")
    table = materialize(ratios(events), "ratios")
    total = table.agg(F.sum("n")).first()[0] or 0
    found = _hot_join(events.select("uid", "gram", "k"), table, "gram", total)
    sums = found.groupBy("uid").agg(*[F.sum(F.col("k") * F.col("r")[i]).alias(f"s{i}") for i in range(FOLDS + 1)])
    each = urls.join(sums, "uid", "left")
    by = lambda c: F.round(F.coalesce(c, F.lit(0)) / SCALE / F.greatest("size", F.lit(1)), 9)
    held = F.element_at(F.array(*[f"s{i}" for i in range(FOLDS)]), (F.pmod("g", F.lit(FOLDS)) + 1).cast("int"))
    each = materialize(each.select("uid", "g", "m", by(F.col(f"s{FOLDS}")).alias("score"), by(held).alias("held")), "scores")
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("held") + 4) * (BINS / 8)))).cast("int")
    got = each.where("g >= 0").groupBy(place.alias("bin"), F.floor(F.col("g") / FOLDS).cast("int").alias("good")).agg(F.sum("m").alias("n")).collect()  # at most 2 x BINS rows
    count = np.zeros((2, BINS))
    for row in got:
        count[row.good, row.bin] += row.n
    threshold = 0.0
    if count[0].sum() and count[1].sum():
        right = np.r_[0, np.cumsum(count[0])] / count[0].sum() + 1 - np.r_[0, np.cumsum(count[1])] / count[1].sum()
        best = np.flatnonzero(right >= right.max() - 1e-12)
        threshold = float(best[len(best) // 2] * (8 / BINS) - 4)
    return each.select("uid", "score"), threshold


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict and score for every row: the rule's verdict where one fits, else the models'.

    A URL that is null or empty scores 0. A score at or above the threshold allows. Every row gives one row, and every row
    with a rule counts in the models; other columns are not read. An empty table gives no rows. Bytes are told apart as they
    are, so letters count with their case.
    """
    base = materialize(with_rules(df.select(F.col(key).alias("__key"), F.col(url).alias("url")), rules).withColumn("__url", F.coalesce("url", F.lit(""))), "urls")
    good = F.when(F.col("ruling").isNotNull(), (F.col("ruling") == "allow").cast("int") * FOLDS + F.pmod(F.xxhash64("__url"), F.lit(FOLDS))).otherwise(-1)
    each = base.groupBy("__url").agg(F.max(good).cast("int").alias("g"), F.count("*").alias("m"))
    each = materialize(each.select(F.monotonically_increasing_id().alias("uid"), F.col("__url").alias("url"), F.octet_length("__url").alias("size"), "g", "m"), "distinct")
    found, threshold = scores(each)
    scored = materialize(each.select("uid", F.col("url").alias("__url"), F.col("m").alias("n")).join(found, "uid").drop("uid"), "scored")
    total = scored.agg(F.sum("n")).first()[0] or 0
    out = _hot_join(base, scored, "__url", total)
    return out.select(F.col("__key").alias(key), "host", "path", "rule", F.coalesce("ruling", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")

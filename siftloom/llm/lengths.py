"""Token counts as an exact length histogram whose suffix sums answer totals, quantiles and truncated totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths per block of the two-level suffix sum.
BLOCK = 1024


def histogram(counts: DataFrame, length: str = "n_tokens", by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` columns, length, n_docs: the documents of each encoded length, combined before the shuffle."""
    return counts.where(F.col(length).isNotNull()).groupBy(*by, F.col(length).alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For every length that occurs, the answers for a context limit of that length.

    docs_ge and tokens_ge (documents at least so long, and their tokens), docs_lt and tokens_lt (shorter ones),
    n_total and tokens_total, truncated_total (sum of min(length, limit)) and quantile (share of documents of at
    most this length). Suffix sums run in blocks of 1024 lengths, and over one row per block, so no task holds more
    than the lengths of a block or the number of blocks. An empty histogram gives no rows.
    """
    h = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy(*by, "block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("block"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    blocks = blocks.select(
        *[F.col(c).alias(f"__{c}") for c in by],
        F.col("block").alias("__block"),
        (F.sum("bd").over(above) - F.col("bd")).alias("ad"),
        (F.sum("bt").over(above) - F.col("bt")).alias("at"),
        F.sum("bd").over(whole).alias("n_total"),
        F.sum("bt").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy(*by, "block").orderBy(F.desc("length"))
    h = h.withColumn("sd", F.sum("n_docs").over(inside)).withColumn("st", F.sum("tokens").over(inside))
    on = F.col("block") == F.col("__block")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return h.join(blocks, on).select(
        *by,
        "length",
        "n_docs",
        (F.col("sd") + F.col("ad")).alias("docs_ge"),
        (F.col("st") + F.col("at")).alias("tokens_ge"),
        (F.col("n_total") - F.col("sd") - F.col("ad")).alias("docs_lt"),
        (F.col("tokens_total") - F.col("st") - F.col("at")).alias("tokens_lt"),
        "n_total",
        "tokens_total",
        (F.col("tokens_total") - F.col("st") - F.col("at") + F.col("length") * (F.col("sd") + F.col("ad"))).alias("truncated_total"),
        ((F.col("n_total") - F.col("sd") - F.col("ad") + F.col("n_docs")) / F.col("n_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: DataFrame, limit: str = "context") -> DataFrame:
    """Answers for any context limits (a small table): documents and tokens above, and the truncated total.

    A limit takes the row of the smallest length that is at least the limit; above the longest document nothing is cut.
    """
    s = sums.select("length", "docs_ge", "tokens_ge", "n_total", "tokens_total")
    totals = s.agg(F.max("n_total").alias("n_total"), F.max("tokens_total").alias("tokens_total"))
    first = (
        F.broadcast(limits.select(limit).where(F.col(limit).isNotNull()).distinct())
        .join(s.select("length", "docs_ge", "tokens_ge"), F.col("length") >= F.col(limit), "left")
        .groupBy(limit)
        .agg(F.min(F.struct("length", "docs_ge", "tokens_ge")).alias("s"))
    )
    return first.join(F.broadcast(totals)).select(
        limit,
        F.coalesce("s.docs_ge", F.lit(0)).alias("docs_ge"),
        F.coalesce("s.tokens_ge", F.lit(0)).alias("tokens_ge"),
        (F.col("tokens_total") - F.coalesce("s.tokens_ge", F.lit(0)) + F.col(limit) * F.coalesce("s.docs_ge", F.lit(0))).alias("truncated_total"),
        "n_total",
        "tokens_total",
    )

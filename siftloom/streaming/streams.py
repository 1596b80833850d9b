"""Structured Streaming forms of the polling loops: memory sampling, change detection, incremental dedup."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from siftloom.session import new_path

#: State of ``drain``: on disk, without the count of keys, which would read each key once more.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256"}


def windowed_usage(samples: DataFrame, width: str = "10 seconds", delay: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    """start, n, avg and max of each tumbling window; windows close ``delay`` after their end."""
    w = samples.withWatermark(time, delay) if samples.isStreaming else samples
    got = w.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg_value"), F.max(value).alias("max_value"))
    return got.select(F.col("w.start").alias("start"), "n", "avg_value", "max_value")


def new_blocks(blocks: DataFrame, digest: str = "md5") -> DataFrame:
    """Blocks whose digest was not seen before; the state store is the index."""
    return blocks.dropDuplicates([digest])


def changed(frames: list[tuple[int, str]], last: str | None, percent: float = 99.0) -> tuple[list[int], str | None]:
    """Frames (id, bits) less than ``percent`` similar to the last emitted one; the first frame is the base, not emitted."""
    out = []
    for i, bits in frames:
        if last is None:
            last = bits
            continue
        same = sum(a == b for a, b in zip(bits, last, strict=False))
        if 100 * same / max(len(bits), 1) < percent:
            out.append(i)
            last = bits
    return out, last


def change_points(frames: DataFrame, by: str = "screen", key: str = "frame", bits: str = "bits", percent: float = 99.0) -> DataFrame:
    """by and key of the frames that differ from the last emitted one, as a batch or a stream."""
    schema = f"{by} {frames.schema[by].dataType.simpleString()}, {key} long"
    cols = frames.select(by, F.col(key).cast("long").alias(key), bits)
    if not frames.isStreaming:

        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key)
            got, _ = changed(list(zip(pdf[key], pdf[bits], strict=True)), None, percent)
            return pd.DataFrame({by: [pdf[by].iloc[0]] * len(got), key: got})

        return cols.groupBy(by).applyInPandas(batch, schema)

    def run(group: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(key)
        got, last = changed(list(zip(rows[key], rows[bits], strict=True)), last, percent)
        state.update((last,))
        yield pd.DataFrame({by: [group[0]] * len(got), key: got})

    return cols.groupBy(by).applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is now and return its rows.

    Rows that are appended go to Parquet files of the shared folder, and the state lies in RocksDB on the executors' disks:
    neither the driver nor a heap holds what grows with the input. Other modes, whose result is an aggregate, give the
    memory table ``name``.
    """
    spark = stream.sparkSession
    w = stream.writeStream.outputMode(mode).queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    if mode != "append":
        w.format("memory").start().awaitTermination()
        return spark.table(name)
    path = new_path(spark, "drained")
    if not checkpoint:
        w = w.option("checkpointLocation", new_path(spark, "stream"))
    with _settings(spark, STATE):
        query = w.format("parquet").option("path", path).start()  # takes the settings along
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings as ``values`` for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

"""Session helpers: the shared folder for intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast once its size has been counted.
BROADCAST_ROWS = 50_000

#: Bytes of a row group that a task holds in memory while it writes a stored table.
ROW_GROUP = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder (tests); a cluster gets an error,
    since a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or _own.get(id(spark.sparkContext))
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own[id(spark.sparkContext)] = "file://" + tempfile.mkdtemp(prefix="siftloom-")
    return folder.rstrip("/")


_own: dict[int, str] = {}


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/siftloom/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts lineage and survives lost executors, and later reads prune columns. ``codec``: for large tables that zstd makes smaller.
    """
    path = new_path(df.sparkSession, tag)
    rows = df.write.option("parquet.block.size", ROW_GROUP)
    (rows.option("compression", codec) if codec else rows).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._siftloom_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_siftloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs now: it does so once the driver has collected their handles."""
    for _ in range(2):  # the first collection lets go of what the second one finds, and files are deleted in the background
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a count shows that it has at most ``rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

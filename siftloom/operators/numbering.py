"""Row numbers over a whole table in order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.session import materialize

#: monotonically_increasing_id holds the partition above this many bits and the row below.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with a long ``name``: the row's number from 0 on in ``order``.

    Rows are dealt out by range and sorted; a row's number is its place in its partition plus the rows of the partitions
    before, whose counts are few (one a partition) and are broadcast. Rows that agree in ``order`` are numbered as they
    come. An empty table gives no rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn("__part", F.shiftrightunsigned("__at", ROW_BITS))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    joined = placed.join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)).drop("__at", "__part", "__p", "__before")

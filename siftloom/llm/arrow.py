"""Streaming helpers for Arrow functions on executors."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a batch of texts. Spark's default of 64 MiB is held several times over by each task: in the JVM's Arrow
#: buffers, on its way, and in Python.
BATCH_BYTES = 2 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def texts(df: DataFrame) -> DataFrame:
    """``df``, whose rows hold whole texts and go to Python next: lowers the session's bytes per Arrow batch to BATCH_BYTES.

    Only the size of batches changes, no row; a smaller setting stays. A text longer than the limit is a batch of its own.
    """
    conf = df.sparkSession.conf
    if not 0 < size_of(conf.get(_LIMIT, "64m")) <= BATCH_BYTES:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df


def size_of(setting: str) -> int:
    """Bytes of a size as Spark's settings write it: 67108864, 64m, 64MB, 1g."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def release() -> None:
    """Give memory that is free in this Python worker back to the system: workers are kept for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(fn: Callable) -> Callable:
    """``fn`` for mapInArrow, followed by ``release``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def per_row(fn: Callable, schema: pa.Schema, *cols: str, keep: tuple[str, ...] = (), max_bytes: int = 4 << 20) -> Callable:
    """A function for mapInArrow: ``fn(*values of cols)`` gives a tuple of new values for each row.

    ``keep`` columns pass through. Output batches stay near ``max_bytes`` of input text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, out = 0, 0, []
            columns = [batch.column(c) for c in cols]
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in columns]
                size += sum(len(v) for v in values if isinstance(v, (str, bytes)))
                out.append(fn(*values))
                if size >= max_bytes or i + 1 == batch.num_rows:
                    kept = [batch.column(c).slice(start, len(out)) for c in keep]
                    fields = [schema.field(len(keep) + k).type for k in range(len(schema) - len(keep))]
                    yield pa.RecordBatch.from_arrays(kept + [pa.array(v, t) for v, t in zip(zip(*out, strict=True), fields, strict=True)], schema=schema)
                    start, size, out = i + 1, 0, []

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000, size: int = 6 << 20) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or ``size`` bytes from sorted batches that never cut a run of equal ``keys``.

    A longer run comes whole; callers bound their runs by chunking hot keys before the shuffle.
    """
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.nbytes
        if n >= rows or held_bytes >= size:
            table = pa.Table.from_batches(held)
            cut = int(starts(table, keys)[-1])
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).combine_chunks()
                held, n, held_bytes = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which the values of ``keys`` change, 0 included; keys hold no nulls."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.session import shared_dir, ship

__all__ = ["cut", "few", "kept", "near", "pieces", "shared_dir", "ship", "table", "turn"]

#: Rows, of some tens of bytes each, up to which a counted table is broadcast; rows that one task of a counted table takes.
BROADCAST_ROWS, TASK_ROWS = 200_000, 40_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in no more partitions than they need: a small table costs few tasks and files, however
    many partitions the session has."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def near(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast where it has at most so many rows; it should be cheap to count, such as a checkpoint."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def pieces(batches, rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most so many rows and, but for single rows, bytes: what Python holds at once."""

    def halved(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if piece.num_rows <= 1 or piece.nbytes <= size:
            yield piece
        else:
            yield from halved(piece.slice(0, piece.num_rows // 2))
            yield from halved(piece.slice(piece.num_rows // 2))

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from halved(batch.slice(at, rows))


#: What a worker keeps from task to task, by operator; the operator whose task it ran last.
_KEPT: dict[str, list] = {}
_last: str | None = None


def kept(operator: str, most: int = 4):
    """lru_cache() for tables that tasks of an operator share in a worker, until turn() gives the worker to another."""

    def wrap(f):
        cached = lru_cache(maxsize=most)(f)
        _KEPT.setdefault(operator, []).append(cached)
        return cached

    return wrap


def turn(operator: str) -> None:
    """A task of this operator begins: where the worker last ran another's, that one's tables go and their memory returns to
    the system. Workers outlive stages, so without it one holds the tables of all operators that it ever ran."""
    global _last
    if operator == _last:
        return
    for name, caches in _KEPT.items():
        if name != operator:
            for c in caches:
                c.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: its own policy holds
    _last = operator

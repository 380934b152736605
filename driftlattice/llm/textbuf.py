"""Shared helpers: reading tables and seeing Arrow string columns as one UTF-8 byte buffer."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlattice.session import checkpoint_dir, checkpointed


__all__ = ["bounded_batches", "checkpoint_dir", "checkpointed", "chunks", "forget", "held_out", "kept", "read_table", "row_of", "stored", "temporary_tables", "utf8"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = 4 << 20):
    """Runs of whole rows of about `most` bytes: (first row, row after the last, bytes, offsets)."""
    data, offs = utf8(column)
    first = 0
    while first < len(offs) - 1:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, side="right")) - 1)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


_KEPT: dict = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def kept(name, make):
    """What a Python worker keeps between its tasks under a name. It keeps one thing at a time, so that the tables of
    operators that follow one another in a worker don't add up."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drops what `kept` holds and gives free memory back to the system, as workers outlive their tasks."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def row_of(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offs, positions, side="right") - 1


_TEMPORARY: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if (paths := _TEMPORARY.get()) is not None:
        paths.append(path)
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Deletes the tables that `stored` writes inside. Gives a function that deletes those so far but the last one: what
    was written on the way to it. At the end the last one stays; after an error none does."""
    paths: list[str] = []

    def delete(gone: list[str]) -> None:
        for name in gone:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def all_but_last() -> None:
        delete(paths[:-1])
        del paths[:-1]

    token = _TEMPORARY.set(paths)
    try:
        yield all_but_last
        all_but_last()
    except BaseException:
        delete(paths)
        raise
    finally:
        _TEMPORARY.reset(token)


def held_out(doc_id: Column) -> Column:
    """True for the rows that nothing may learn from: crc32 of doc_id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Arrow batches of rows with whole texts stay small, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))

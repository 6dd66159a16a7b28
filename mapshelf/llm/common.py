"""Shared pieces: document keys, written intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.session import scratch_path

#: A null id takes part as this number, below all others, and becomes null again in results.
NULL_ID = -(2**63)

WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, v, text): the id, a hash of the text and the text.

    Rows that agree in both are the same document written twice and share their results; rows
    that share an id only are documents of their own. Other columns are left out, so their names do not matter.
    """
    return docs.select(*key(id_col, text_col), F.col(text_col).cast("string").alias("text"))


def key(id_col: str, text_col: str) -> list:
    """(k, v): the id and a 64-bit hash of the text and its length, which tells apart the rows that share an id."""
    text = F.col(text_col).cast("string")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text, F.octet_length(text)).alias("v")]


def real_id(column: str = "k"):
    """The id of a key, null where it stands for a missing one."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


@contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Spark removes the shuffle files of a write inside this block when the write has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    A lost executor then costs a re-read, and its shuffle files need not be kept any longer.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, label)
    with shuffle_files_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: What empties the memories that modules keep from task to task.
leftovers: list[Callable[[], None]] = []


def give_back() -> None:
    """Return to the system what earlier tasks of this Python process left: memories of other operators, and emptied heaps."""
    for forget in leftovers:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that leaves its worker no larger than it must, and does not begin with what others left there."""
    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()
    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values of ``column`` have at most ``limit`` bytes together, or one row."""
    ends = np.cumsum(byte_lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def byte_lengths(array: pa.Array) -> np.ndarray:
    return np.diff(raw_bytes(array)[1])


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the n + 1 offsets of its values; a null has none."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of these columns, each cast to its field."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

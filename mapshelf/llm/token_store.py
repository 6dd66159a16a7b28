"""Token ids in ORC files.

Documents stand in ascending order of their id over files and within each. ORC packs the ids with integer run-length encoding, keeps
minima and maxima of the document id for each stripe and each group of rows, and a Bloom filter of it, so a reader looks
up one document or a range without reading other stripes. Stripes are read in parallel. Each row also holds its file's number and how many
ids stand before it there: with the totals of the files this gives its place among all ids without sorting again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, numbers, pieces, shuffle_files_removed
from mapshelf.llm.tokens import default_path, encoder

COLUMNS = "doc_id long, shard int, at long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe: int = 16 << 20, stride: int = 1000) -> None:
    """Encode each whole text, append ``end_id`` and write the ids below ``path``.

    A null or empty text has the end id alone. Null ids come first; rows of one id follow each other in the order of a hash of their text. An empty table
    writes no rows. Other columns are left out.
    """
    source = tokenizer or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        for part in (p for b in batches for p in pieces(b, "text", 1 << 20)):
            found, edge = encoder(source).encode_array(part.column("text"))
            offsets = edge + np.arange(len(edge))
            values = np.insert(found.astype("<i4"), edge[1:], end_id)
            yield batch(schema, part.column("id"), np.full(part.num_rows, shard, np.int32), before + offsets[:-1], np.diff(offsets), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)))
            before += int(offsets[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text")).mapInArrow(encode, COLUMNS)
    with shuffle_files_removed(docs.sparkSession):
        (ordered.write.option("orc.stripe.size", stripe).option("orc.row.index.stride", stride).option("orc.create.index", "true")
         .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("compression", "zstd").orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` is the number of ids of all documents before. Filters on ``doc_id`` skip stripes and row groups."""
    rows = spark.read.schema(COLUMNS).orc(path)
    # a document's own columns give its file's total, so the ids need not be read for it
    files = rows.groupBy("shard").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row for each file
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of each row's ids as little-endian unsigned 32-bit numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column("ids")
            offsets, data = numbers(ids.offsets).tolist(), memoryview(numbers(ids.values).astype("<i4")).cast("B")
            found = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(offsets, offsets[1:])]
            yield batch(schema, part.column("doc_id"), part.column("start"), np.diff(offsets), found)

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Packing documents into sequences of a fixed length by bounded-space best-fit.

Documents longer than a sequence are cut; the rest of a document and all shorter ones are placed one after the other. A fixed number of
sequences is open at any time. They are found through a bitset over their free space: the lowest set bit at or above a length
is the best fit, and the lowest of all belongs to the fullest, which closes when too many are open.

Lengths alone decide, so the rows that are packed are a few numbers each; they are dealt over shards by a hash of the document. Within a shard,
pieces come in an order that the data gives, in turns of a fixed number, the longest of a turn first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, keyed, numbers, pieces, real_id, stored
from mapshelf.llm.tokens import default_path, encoder

#: Pieces of one shard, sequences open at a time, pieces of a turn.
SHARD, OPEN, TURN = 40_000, 2048, 2048


class BestFit:
    """Open sequences by their free space."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.made, self.open = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


def best_fit(lengths: Iterable[int], capacity: int, most_open: int = OPEN) -> list[tuple[int, int]]:
    bins = BestFit(capacity, most_open)
    return [bins.place(n) for n in lengths]


def cut(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
        with_ids: bool = False) -> DataFrame:
    """(k, v, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, in pieces of ``capacity`` ids; the first may be shorter."""
    path = tokenizer or default_path()
    schema = pa.schema([("k", pa.int64()), ("v", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.binary()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for part in (p for b in batches for p in pieces(b, "text", 1 << 20)):
            rows = []
            found, edge = encoder(path).encode_array(part.column("text"))
            data, edge = found.astype("<u4").tobytes(), (4 * edge).tolist()
            for k, v, begin, stop in zip(numbers(part.column("k")).tolist(), numbers(part.column("v")).tolist(), edge, edge[1:]):
                ids = data[begin:stop] + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, (a, z) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                    some = ids[4 * a : 4 * z]
                    rows.append((k, v, piece, a, z - a, zlib.crc32(some), some)[: len(schema)])
            yield batch(schema, *(list(c) for c in zip(*rows))) if rows else batch(schema, *([] for _ in schema))

    return keyed(docs, id_col, text_col).mapInArrow(split, "k long, v long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def place(cuts: DataFrame, capacity: int = 2048, most_open: int = OPEN, shard: int = SHARD) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces."""
    names = ["k", "v", "piece", "start", "length", "ids_crc32"]
    shards = max(1, -(-cuts.count() // shard))
    schema = pa.schema([("k", pa.int64()), ("v", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[int, BestFit] = {}
        for part in (b.slice(at, TURN) for b in batches for at in range(0, b.num_rows, TURN)):
            lengths, owner = part.column("length").to_pylist(), part.column("shard").to_pylist()
            found: list = [None] * len(lengths)
            for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
                if owner[i] not in bins:
                    bins[owner[i]] = BestFit(capacity, most_open)
                found[i] = bins[owner[i]].place(lengths[i])
            yield batch(schema, *part.columns, [o << 32 | s for o, (s, _) in zip(owner, found)], [o for _, o in found])

    dealt = cuts.select(*names, F.pmod(F.xxhash64("k", "v"), F.lit(shards)).alias("shard")).repartition(shards, "shard")
    return dealt.sortWithinPartitions("shard", F.xxhash64("v", "k"), *names).mapInArrow(fit, dealt.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long").drop("shard")


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, ``piece``, ``start`` (ids of the document before it), ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` there.

    A document's ids are those of its whole text and the end id, so a null or empty text is one piece of one id. Only documents of more than
    ``capacity`` ids are cut. Offsets of a sequence have no gaps. Rows that repeat an id are documents of their own, and a null id stays null. An empty
    table gives no pieces. Packing again gives the same sequences. Other columns are left out.
    """
    placed = place(stored(cut(docs, capacity, end_id, tokenizer, id_col, text_col), "pieces"), capacity)
    return placed.select(real_id().alias(id_col), "k", "v", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed ids themselves, little-endian unsigned 32-bit numbers, for ``placed`` pieces of ``docs``.

    Repeated rows (equal id and text) have equal ids, so it does not matter which of them fills which place.
    """
    ids = cut(docs, capacity, end_id, tokenizer, id_col, text_col, with_ids=True).dropDuplicates(["k", "v", "piece"]).select("k", "v", "piece", "ids")
    parts = placed.select("k", "v", "piece", "sequence_id", "offset").join(ids, ["k", "v", "piece"])
    whole = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(whole.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))

"""Substring de-duplication over super-k-mers.

A window is ``size`` consecutive words of one document. Its minimiser is the smallest hash of
``gram`` consecutive words inside it, those without short words first: long words are rarer, and buckets more even. Consecutive windows that share a minimiser form a super-k-mer;
its words travel once, as one string, to the bucket of the minimiser. All occurrences of a window have the same
minimiser, so a bucket sees all of them: it sorts the windows, and all but the first
occurrence of each are repeats. Equal hashes are confirmed on the words themselves.

Buckets grow with the corpus, as a common word is the minimiser of the same share of all windows. One that many super-k-mers share
is parted by the word next to the minimiser, the one after it, or before it in a window that ends with the minimiser. What is
large even so (a common line or passage) is dealt out by document. An
occurrence that is not the first of its share is a repeat whatever the other shares hold; the first ones go on as single
windows, at most one a share, to a second round whose key is the window itself. A bucket is read in slices, so a task holds
its strings and some 20 bytes for each of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapshelf.llm.common import batch, key, keyed, numbers, partitions, pieces, raw_bytes, stored
from mapshelf.llm.words import Words, leftmost_minimum, mix, ranges, sequence_hash

GRAM, LONG = 1, 6
#: Windows of one super-k-mer, whose number is one byte of the packed string; a longer one is cut.
MOST = 255
#: Buckets whose sizes are counted, for each shuffle partition; a bucket of more than HOT times the mean, a quarter of a partition's share, is parted, then dealt out.
CELLS, HOT = 16, 4
#: Bytes of a bucket whose words are looked at together, and windows that leave it together.
SLICE, OUT = 1 << 20, 1 << 14

_GRAMS = pa.schema([("key", pa.int32()), ("packed", pa.binary())])
_FOUND = pa.schema([("k", pa.int64()), ("v", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("key", pa.int32()), ("packed", pa.binary())])
#: What a packed string begins with: its document, its first window there, its windows, and whether its bucket is dealt out.
_HEAD = np.dtype([("k", "<i8"), ("v", "<i8"), ("start", "<i4"), ("n", "u1"), ("dealt", "u1")])
_SALT = np.uint64(0xA0761D6478BD642F)


def _super_kmers(words: Words, size: int, gram: int, large: np.ndarray | None = None):
    """(bucket, first window, number of windows, whether parted) of the texts' super-k-mers; the buckets in ``large`` cells are parted by a word next to the minimiser."""
    key, first, n, at = _minimisers(words, size, gram)
    if large is None or not len(key):
        return key, first, n, np.zeros(len(key), bool)
    parted = large[_cells(key, len(large))]
    if size == gram:  # there is no other word
        return key, first, n, parted
    # Only the first window of a super-k-mer can end with its minimiser.
    ends = parted & (at + gram == first + size)
    times = 1 + (ends & (n > 1))
    row = np.repeat(np.arange(len(key)), times)
    later = np.zeros(len(row), bool)
    later[1:] = row[1:] == row[:-1]
    lone = ends[row] & ~later
    beside = np.minimum(np.where(lone, at[row] - 1, at[row] + gram), len(words.hash) - 1)
    key = np.where(parted[row], mix(key[row].view(np.uint64) ^ mix(words.hash[beside] + lone)).view(np.int64), key[row])
    return key, first[row] + later, np.where(times[row] == 1, n[row], np.where(later, n[row] - 1, 1)), parted[row]


def _minimisers(words: Words, size: int, gram: int):
    """(minimiser, first window, number of windows, first word of the minimiser) of the texts' super-k-mers."""
    if len(words.hash) < size:
        return (np.zeros(0, np.int64),) * 4
    value = sequence_hash(words.hash, gram)
    short = words.ends - words.starts < LONG
    short = np.logical_or.reduce([short[j : j + len(value)] for j in range(gram)])
    value = value >> np.uint64(1) | short.astype(np.uint64) << np.uint64(63)
    best = leftmost_minimum(value, size - gram + 1)
    window = np.flatnonzero(words.room()[: len(best)] >= size)
    best = best[window]
    new = np.ones(len(window), bool)
    new[1:] = (best[1:] != best[:-1]) | (window[1:] != window[:-1] + 1)
    if size - gram >= MOST:
        at = np.arange(len(window))
        new = (at - np.maximum.accumulate(np.where(new, at, 0))) % MOST == 0
    first = np.flatnonzero(new)
    return value[best[first]].view(np.int64), window[first], np.diff(np.append(first, len(window))), best[first]


def _cells(key: np.ndarray, cells: int) -> np.ndarray:
    return (key.view(np.uint64) % np.uint64(cells)).astype(np.int64)


def _bucket_sizes(docs: DataFrame, size: int, gram: int, cells: int, large: np.ndarray | None = None) -> dict[int, int]:
    """Super-k-mers by cell of their bucket, of the parted ones only where some are: at most ``cells`` numbers, counted over all documents."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(cells, np.int64)
        for part in (p for b in batches for p in pieces(b, "text")):
            key, _, _, parted = _super_kmers(Words(part.column("text")), size, gram, large)
            found += np.bincount(_cells(key if large is None else key[parted], cells), minlength=cells)
        at = np.flatnonzero(found)
        yield batch(schema, at, found[at])

    counted = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r["cell"]: r["n"] for r in counted.collect()}


def _cut(docs: DataFrame, size: int, gram: int, cells: int, large: np.ndarray | None, shares: dict[int, int]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = np.ones(cells, np.uint64)
        for cell, n in shares.items():
            dealt[cell] = n
        for part in (p for b in batches for p in pieces(b, "text")):
            words = Words(part.column("text"))
            key, first, n, parted = _super_kmers(words, size, gram, large)
            if not len(key):
                continue
            text = words.text_of()[first]
            head = np.zeros(len(key), _HEAD)
            head["k"], head["v"] = numbers(part.column("k"))[text], numbers(part.column("v"))[text]
            head["start"], head["n"] = first - words.first[text], n
            many = np.where(parted, dealt[_cells(key, cells)], np.uint64(1))
            head["dealt"] = many > 1
            share = mix(head["k"].view(np.uint64) ^ head["v"].view(np.uint64) * _SALT) % many
            bucket = (mix(key.view(np.uint64) + share) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            joined, starts, ends = words.joined()
            yield batch(_GRAMS, bucket, _packed(head, joined, starts[first].tolist(), ends[first + n + size - 2].tolist()))

    return docs.mapInArrow(cut, "key int, packed binary")


def _packed(head: np.ndarray, text: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
    data, size = head.tobytes(), _HEAD.itemsize
    return [data[i : i + size] + text[a:z] for i, a, z in zip(range(0, len(data), size), starts, ends)]


def _windows(packed: pa.Array, size: int, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, last byte) of the windows of packed strings that are taken in this order; the bytes are those of ``raw_bytes``."""
    offsets = raw_bytes(packed)[1]
    length = np.diff(offsets)[order]
    total = int(n.sum())
    whole, starts, ends = np.empty(total, np.uint64), np.empty(total, np.int32), np.empty(total, np.int32)
    cut = np.flatnonzero(np.diff(np.cumsum(length) // SLICE, prepend=-1))
    done = 0
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
        words = Words(pa.array([p[_HEAD.itemsize :] for p in packed.take(pa.array(order[a:z])).to_pylist()], pa.binary()))
        at = ranges(words.first[:-1], n[a:z])
        shift = np.repeat(offsets[order[a:z]] + _HEAD.itemsize - words.offsets[:-1], n[a:z])
        here = slice(done, done + len(at))
        whole[here], starts[here], ends[here] = sequence_hash(words.hash, size)[at], words.starts[at] + shift, words.ends[at + size - 1] + shift
        done += len(at)
    return whole, starts, ends


def _repeats(part: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Of whole buckets: runs of repeated windows, and the first windows of dealt buckets."""
    packed, key = part.column("packed"), numbers(part.column("key"))
    raw, offsets = raw_bytes(packed)
    head = raw[offsets[:-1, None] + np.arange(_HEAD.itemsize)].reshape(-1).view(_HEAD)
    order = np.lexsort((head["start"], head["v"], head["k"], key))
    head, key = head[order], key[order]
    k, v, start, n, dealt = head["k"], head["v"], head["start"], head["n"].astype(np.int64), head["dealt"] > 0
    whole, a, b = _windows(packed, size, n, order)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    inside = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    bucket = whole ^ key[row].astype(np.uint64) * _SALT
    order = np.argsort(bucket, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = bucket[order[1:]] == bucket[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    again, first = order[same], lead[same]
    del lead, same
    data = raw.tobytes()
    repeated = np.zeros(len(row), bool)
    unequal = []
    for at in range(0, len(again), OUT):
        one, other = again[at : at + OUT], first[at : at + OUT]
        own = (k[row[one]] != k[row[other]]) | (v[row[one]] != v[row[other]]) | (start[row[one]] + inside[one] != start[row[other]] + inside[other])
        equal = np.fromiter((data[i:j] == data[x:y] for i, j, x, y in zip(a[one].tolist(), b[one].tolist(), a[other].tolist(), b[other].tolist())), bool, len(one))
        repeated[one] = equal & own
        unequal.append(one[~equal])
    for number in np.unique(bucket[np.concatenate(unequal)]) if unequal else ():  # different windows of one hash: told apart by their words
        seen: dict[tuple, int] = {}
        for i in order[np.searchsorted(bucket[order], number) : np.searchsorted(bucket[order], number, side="right")].tolist():
            j = seen.setdefault((key[row[i]], data[a[i] : b[i]]), i)
            repeated[i] = (k[row[i]], v[row[i]], start[row[i]] + inside[i]) != (k[row[j]], v[row[j]], start[row[j]] + inside[j])
    del order, bucket, again, first
    edge = np.ones(len(row), bool)
    edge[1:] = (row[1:] != row[:-1]) | (repeated[1:] != repeated[:-1])
    run = np.flatnonzero(edge)
    last = np.append(run[1:], len(row)) - 1
    keep = repeated[run]
    run, last = run[keep], last[keep]
    none = pa.nulls(len(run), pa.int32()), pa.nulls(len(run), pa.binary())
    if len(run):
        yield batch(_FOUND, k[row[run]], v[row[run]], (start[row[run]] + inside[run]).astype(np.int32), (start[row[last]] + inside[last] + size).astype(np.int32), *none)
    go_on = np.flatnonzero(~repeated & dealt[row])
    for at in range(0, len(go_on), OUT):
        on = go_on[at : at + OUT]
        single = head[row[on]].copy()
        single["start"] += inside[on]
        single["n"], single["dealt"] = 1, 0
        strings = _packed(single, data, a[on].tolist(), b[on].tolist())
        bucket = (whole[on] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        yield batch(_FOUND, single["k"], single["v"], single["start"], single["start"] + size, bucket, strings)


def _resolve(grams: DataFrame, size: int, chunk: int = 4 << 20) -> DataFrame:
    """Runs of repeated windows (key null), and windows that go to the second round."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets together, at least ``chunk`` bytes a time where there are so many."""
        held: list[pa.RecordBatch] = []
        for part in (p for b in batches for p in pieces(b, "packed", chunk)):
            if sum(p.nbytes for p in held) >= chunk:
                other = np.flatnonzero(numbers(part.column("key")) != held[-1].column("key")[-1].as_py())
                if len(other):
                    yield _concat([*held, part.slice(0, int(other[0]))])
                    held, part = [], part.slice(int(other[0]))
            held.append(part)
        if held:
            yield _concat(held)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in buckets(batches):
            if part.num_rows:
                yield from _repeats(part, size)

    return grams.repartition("key").sortWithinPartitions("key").mapInArrow(resolve, "k long, v long, start int, stop int, key int, packed binary")


def _concat(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]


def repeated_spans(docs: DataFrame, size: int = 20, gram: int = GRAM) -> DataFrame:
    """(k, v, start, stop): runs of words of windows that also start earlier, over ``keyed`` documents."""
    spark = docs.sparkSession
    cells = CELLS * partitions(spark)
    sizes = _bucket_sizes(docs, size, gram, cells)
    most = max(64, HOT * sum(sizes.values()) / cells)
    large, shares = None, {}
    if any(n > most for n in sizes.values()):
        large = np.zeros(cells, bool)
        large[[c for c, n in sizes.items() if n > most]] = True
        shares = {c: int(-(-n // most)) for c, n in _bucket_sizes(docs, size, gram, cells, large).items() if n > most}
    found = stored(_resolve(_cut(docs, size, gram, cells, large, shares), size), "substring-round1")
    spans = found.where("key IS NULL").select("k", "v", "start", "stop")
    if not shares:
        return spans
    again = found.where("key IS NOT NULL").select("key", "packed")
    return spans.unionByName(_resolve(again, size).select("k", "v", "start", "stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, gram: int = GRAM) -> DataFrame:
    """Remove each word covered by a window that also starts earlier (smaller id, or earlier in the same document).

    Returns one row per row of ``docs``: the id, ``n_words``, ``n_removed`` and ``kept_text``: the kept words joined by one space.
    Windows are judged on the input, not on what is left.

    * A null or empty text has no words and an empty ``kept_text``.
    * A null id counts as smaller than all others.
    * Rows that repeat an id and text are one document: their windows are no repeats of each other, and each row gets the same
      result. Rows that share only the id are ordered by a hash of their text.
    * A text of any length is handled whole; an empty table gives an empty one. Other columns are left out.
    """
    out = _applied(docs, [F.col(id_col)], id_col, text_col, size, gram)
    return out.select(F.col(f"row.{id_col}").alias(id_col), "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, gram: int = GRAM) -> DataFrame:
    """The documents with all their columns, and the words left as their text where any went. Rows are as in ``remove_repeats``."""
    out = _applied(docs, [F.col(c) for c in docs.columns], id_col, text_col, size, gram)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row")[text_col].cast("string"))
    return out.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def _applied(docs: DataFrame, columns: list, id_col: str, text_col: str, size: int, gram: int) -> DataFrame:
    """(row, n_words, n_removed, kept_text), row holding these columns."""
    spans = repeated_spans(keyed(docs, id_col, text_col), size, gram).groupBy("k", "v").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = docs.select(F.struct(*columns).alias("row"), *key(id_col, text_col), F.col(text_col).cast("string").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "text", 8 << 20)):
            total, removed, kept = [], [], []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                words = (text or "").encode().split()
                total.append(len(words))
                if found:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, [s["start"] for s in found], 1)
                    np.add.at(gone, [s["stop"] for s in found], -1)
                    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    words = [words[i] for i in left.tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["row", "n_words", "n_removed", "kept_text"])

    joined = rows.join(spans, ["k", "v"], "left").select("row", "text", "spans")
    kinds = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(apply, kinds)

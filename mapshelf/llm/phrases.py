"""Phrases whose words stand together more often than apart, counted over FM-indexes.

The texts of a language are cut into shards of a bounded number of words. A shard's words are numbered, and its pieces are kept as the
Burrows-Wheeler transforms of the number sequence and of its reverse, sorted as deep as the longest phrase. A phrase is an interval
in both orders. The symbols of the one transform inside its interval are the words before it, those of the other the words
after it; grouping them extends the phrase on either side, with the count of each extension and both of its new intervals.

Phrases grow by one word in each round. A shard extends those that are frequent over all shards on both sides; a longer phrase is a
candidate where its beginning and its end are both frequent, which is where the two extensions meet. The counts of the candidates go, as
sorted arrays, to the task that sums their part of the key space, and each shard hears which of its own were frequent. So what is shuffled is
one number for each different phrase of a shard, however often it occurs, and nothing is dropped before its exact count is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, partitions, pieces, stored
from mapshelf.llm.words import Words, mix

#: Words of a shard.
SHARD = 1 << 18
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BETWEEN = _BREAKS.copy()
_BETWEEN[[0x20, 0x09]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)

_SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("forward", pa.binary()), ("reverse", pa.binary())])
_COUNTS = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_FOUND = pa.schema([("shard", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("totals", pa.binary()), ("mine", pa.binary())])


def _packed(ids: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of all of them, compressed."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(ids).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return planes.T.copy().view("<u4").ravel().astype(np.int32)


def _transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """What stands before each suffix, in the order of their first ``depth`` symbols or more; the sequence is circular."""
    rank, span = ids.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -span)
        order, span = np.argsort(key, kind="stable"), 2 * span
        if span >= depth:
            return ids[order - 1]
        new = np.zeros(len(ids), np.int64)
        new[order[1:]] = key[order[1:]] != key[order[:-1]]
        rank = np.empty_like(new)
        rank[order] = np.cumsum(new[order])


@dataclass
class Phrases:
    """Phrases of one length in a shard: words (a row each), start in both orders, count, key."""

    ids: np.ndarray
    low: np.ndarray
    back: np.ndarray
    n: np.ndarray
    key: np.ndarray

    def at(self, which: np.ndarray) -> Phrases:
        return Phrases(self.ids[which], self.low[which], self.back[which], self.n[which], self.key[which])


class Index:
    """The bidirectional index of a shard. Symbol 0 stands between pieces; word i has hash ``hashes[i - 1]``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, forward: np.ndarray, reverse: np.ndarray):
        self.hashes, self.counts, self.sides = hashes, counts, (forward, reverse)
        self.first = len(forward) - int(counts.sum()) + np.cumsum(counts) - counts
        self._steps: list[np.ndarray | None] = [None, None]

    def words(self) -> Phrases:
        ids = np.arange(1, len(self.counts) + 1)
        return Phrases(ids[:, None], self.first, self.first, self.counts, mix(self.hashes * _STEP))

    def _step(self, side: int) -> np.ndarray:
        """Where the suffix that is one symbol longer stands."""
        if self._steps[side] is None:
            order = np.argsort(self.sides[side], kind="stable")
            self._steps[side] = np.empty(len(order), np.int64)
            self._steps[side][order] = np.arange(len(order))
        return self._steps[side]

    def _extended(self, start: np.ndarray, n: np.ndarray, side: int):
        """(phrase, symbol, count, start on this side, how many smaller symbols come before) for each extension of each phrase."""
        base = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(base - start, n)
        symbol = self.sides[side][at].astype(np.int64)
        key = row * (len(self.counts) + 1) + symbol
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        first = order[edge]
        return row[first], symbol[first], np.diff(np.append(edge, len(key))), self._step(side)[at[first]], edge - base[row[first]]

    def grown(self, some: Phrases) -> Phrases:
        """Phrases one word longer of which both the beginning and the end are among ``some``."""
        owner, word, n, back, smaller = self._extended(some.back, some.n, 1)
        low = some.low[owner] + smaller
        _, before, _, left, _ = self._extended(some.low, some.n, 0)
        keep = np.flatnonzero((word > 0) & np.isin(low, left[before > 0]))
        owner, word = owner[keep], word[keep]
        key = mix(some.key[owner] + mix(self.hashes[word - 1] * _STEP) * np.uint64(3))
        return Phrases(np.column_stack([some.ids[owner], word]), low[keep], back[keep], n[keep], key)


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word hashes with a 0 before each piece; the distinct hashes and their words."""
    words = Words(texts, lower=True, between=_BETWEEN)
    if not len(words.hash):
        return words.hash, words.hash, []
    breaks = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_BREAKS[words.data], out=breaks[1:])
    text = words.text_of()
    new = np.ones(len(words.hash), bool)
    new[1:] = (breaks[words.starts[1:]] != breaks[words.ends[:-1]]) | (text[1:] != text[:-1])
    known, at = np.unique(words.hash, return_index=True)
    data = words.data.tobytes()
    return np.insert(words.hash, np.flatnonzero(new), np.uint64(0)), known, [data[a:z] for a, z in zip(words.starts[at].tolist(), words.ends[at].tolist())]


def shards(docs: DataFrame, longest: int = 4, size: int = SHARD, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(shard, lang, hashes, counts, words, forward, reverse): indexes over the documents of a task, about ``size`` words of one language each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[str, list] = {}
        room: dict[str, int] = {}
        for part in (p for b in batches for p in pieces(b, "text")):
            langs = part.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                rows = pa.array([x == lang for x in langs])
                found = _sequence(part.column("text").filter(rows))
                if len(found[0]):
                    held.setdefault(lang, []).append(found)
                    room[lang] = room.get(lang, 0) + len(found[0])
            # Large ones go first, then the largest, so that a task holds a bounded number of words of any number of languages.
            for lang in [x for x in room if room[x] >= size] or ([max(room, key=room.get)] if sum(room.values()) >= 2 * size else []):
                yield index(number, lang, held.pop(lang))
                room.pop(lang)
                number += 1
        for lang in held:
            yield index(number, lang, held[lang])
            number += 1

    def index(number: int, lang: str, found: list) -> pa.RecordBatch:
        text = dict(pair for _, known, words in found for pair in zip(known.tolist(), words))
        sequence = np.concatenate([x for x, _, _ in found])
        hashes, ids = np.unique(sequence, return_inverse=True)  # the smallest is the 0 between pieces
        ids = ids.astype(np.int32)
        words = b" ".join(text[h] for h in hashes[1:].tolist())
        sides = [_packed(_transform(x, longest)) for x in (ids, ids[::-1])]
        return batch(_SHARDS, [number], [lang], [hashes[1:].tobytes()], [np.bincount(ids)[1:].astype("<i8").tobytes()], [words], [sides[0]], [sides[1]])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(build, "shard long, lang string, hashes binary, counts binary, words binary, forward binary, reverse binary")


def _dealt(shard: int, phrases: Phrases, salt: np.uint64, buckets: int) -> Iterator[pa.RecordBatch]:
    """A shard's counts, sorted by key and cut by the bucket that a key belongs to."""
    key = mix(phrases.key ^ salt)
    order = np.argsort(key)
    key, n = key[order], phrases.n[order].astype("<i8")
    bucket = (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, np.int64)
    stop = np.append(edge[1:], len(key))
    parts = [(key[a:z].tobytes(), n[a:z].tobytes()) for a, z in zip(edge.tolist(), stop.tolist())]
    yield batch(_COUNTS, bucket[edge].astype(np.int32), [shard] * len(edge), [k for k, _ in parts], [c for _, c in parts])


def _summed(counts: DataFrame, level: int, least: int, buckets: int) -> DataFrame:
    """Of each shard's keys, those that occur ``least`` times over all shards, their totals, and whether the shard is the one that names them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[int] = []
        keys: list[np.ndarray] = []
        count: list[np.ndarray] = []
        for part in batches:
            shard += part.column("shard").to_pylist()
            keys += [np.frombuffer(x, np.uint64) for x in part.column("keys").to_pylist()]
            count += [np.frombuffer(x, "<i8") for x in part.column("counts").to_pylist()]
        if not shard:
            return
        length = np.array([len(x) for x in keys])
        all_keys = np.concatenate(keys)
        order = np.argsort(all_keys, kind="stable")
        in_order = all_keys[order]
        edge = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        total = np.add.reduceat(np.concatenate(count)[order], edge)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
        mine = np.zeros(len(order), np.uint8)
        mine[order[edge]] = 1
        often = total[group] >= least
        stop = np.cumsum(length)
        for number, a, z in zip(shard, (stop - length).tolist(), stop.tolist()):
            keep = np.flatnonzero(often[a:z]) + a
            if len(keep):
                yield batch(_FOUND, [number], [level], [all_keys[keep].tobytes()], [total[group[keep]].astype("<i8").tobytes()], [mine[keep].tobytes()])

    return counts.repartitionById(buckets, "bucket").mapInArrow(add, "shard long, level int, keys binary, totals binary, mine binary")


def _opened(row: dict) -> Index:
    return Index(np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], "<i8"), _unpacked(row["forward"]), _unpacked(row["reverse"]))


def _with_found(indexes: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Each shard's row (level 0), then its rows of found keys."""
    rows = indexes.withColumn("level", F.lit(0))
    for table in found:
        rows = rows.unionByName(table, allowMissingColumns=True)
    return rows.repartition("shard").sortWithinPartitions("shard", "level")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[int, list[dict]]]]:
    """A shard's row, and its rows of found keys by level."""
    here, found = None, {}
    for row in (b.slice(at, 1).to_pylist()[0] for b in batches for at in range(b.num_rows)):
        if row["level"] == 0:
            if here:
                yield here, found
            here, found = row, {}
        else:
            found.setdefault(row["level"], []).append(row)
    if here:
        yield here, found


def _levels(index: Index, salt: np.uint64, found: dict[int, list[dict]]) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
    """The frequent phrases of each length, their totals, and which of them this shard names."""
    phrases = index.words()
    for level in sorted(found):
        if level > 1:
            phrases = index.grown(phrases)
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in found[level]])
        order = np.argsort(keys)
        keys = keys[order]
        total = np.concatenate([np.frombuffer(r["totals"], "<i8") for r in found[level]])[order]
        mine = np.concatenate([np.frombuffer(r["mine"], np.uint8) for r in found[level]])[order]
        own = mix(phrases.key ^ salt)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        which = np.flatnonzero(keys[at] == own)
        phrases, at = phrases.at(which), at[which]
        yield phrases, total[at], mine[at] > 0


def frequent(docs: DataFrame, least: int = 30, longest: int = 4, size: int = SHARD, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f), (lang, n)): the phrases of 1 to ``longest`` words that occur ``least`` times in a language, and its words in all.

    Both are written tables. A phrase is its words joined by one space; words and phrases are known by 64-bit hashes on the way.
    """
    indexes = stored(shards(docs, longest, size, text_col, lang_col), "phrases-shards")
    buckets = partitions(docs.sparkSession)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            words = Index(np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], "<i8"), np.zeros(0, np.int32), np.zeros(0, np.int32)).words()
            yield from _dealt(row["shard"], words, _salt(row["lang"]), buckets)

    def longer(level: int):
        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, found in _by_shard(batches):
                if level - 1 in found:
                    index, salt = _opened(row), _salt(row["lang"])
                    *_, (phrases, _, _) = _levels(index, salt, found)
                    yield from _dealt(row["shard"], index.grown(phrases), salt, buckets)

        return grow

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])
        for row, found in _by_shard(batches):
            if found:
                text = [w.decode() for w in row["words"].split(b" ")]
                for phrases, total, mine in _levels(_opened(row), _salt(row["lang"]), found):
                    ids = phrases.ids[mine]
                    said = [" ".join([text[i - 1] for i in p]) for p in ids.tolist()]
                    yield batch(schema, [row["lang"]] * len(said), said, [ids.shape[1]] * len(said), total[mine])

    counted = "bucket int, shard long, keys binary, counts binary"
    found = [stored(_summed(indexes.select("shard", "lang", "hashes", "counts").mapInArrow(single, counted), 1, least, buckets), "phrases-1")]
    for level in range(2, longest + 1):
        grown = _with_found(indexes.select("shard", "lang", "hashes", "counts", "forward", "reverse"), found).mapInArrow(longer(level), counted)
        found.append(stored(_summed(grown, level, least, buckets), f"phrases-{level}"))
    phrases = stored(_with_found(indexes, found).mapInArrow(named, "lang string, phrase string, k int, f long"), "phrases")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield batch(pa.schema([("lang", pa.string()), ("n", pa.int64())]), part.column("lang"), [int(np.frombuffer(x, "<i8").sum()) for x in part.column("counts").to_pylist()])

    total = indexes.select("lang", "counts").mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    return phrases, stored(total, "phrases-languages")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, within: int = 80, top: int = 2000, scale: int = 2_000_000, size: int = SHARD,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language by how much of their parts' occurrences they are.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and 0x0A to 0x0D into pieces, these at spaces and tabs into words. A candidate is
    a phrase of 2 to ``longest`` words that occurs ``least`` times or more within pieces, a = f(phrase). Each cut into two parts that occur l and r
    times has the score floor(scale * a / (l + r)); the lowest counts, the earliest cut among equals. Candidates that stand inside a longer one
    with 100 * f(longer) >= within * a are dropped. Columns: lang, rank (from 1; by score and a, both descending, then the phrase's bytes),
    phrase, a, l, r, n (words of the language), score.

    Counts are exact over whole texts, products are decimals. A null language is ``und``, a null or empty text has no words, repeated rows count
    again, and an empty table gives no rows. Other columns are left out.
    """
    phrases, languages = frequent(docs, least, longest, size, text_col, lang_col)
    some = phrases.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = some.select("lang", "phrase", F.col("f").alias("a"), "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.selectExpr("lang", "phrase", "a", "cut", "array_join(slice(w, 1, cut), ' ') AS first", "array_join(slice(w, cut + 1, k - cut), ' ') AS rest")
    part = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(part.toDF("lang", "first", "l"), ["lang", "first"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
    scored = cuts.withColumn("score", F.expr(f"(cast(a AS decimal(20, 0)) * {scale}BD) div (l + r)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    # Inside a phrase that is longer by more, a candidate is also inside one longer by one word, which occurs at least as often.
    longer = some.where("k > 2").select("lang", F.explode(F.expr("array(array_join(slice(w, 1, k - 1), ' '), array_join(slice(w, 2, k - 1), ' '))")).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR cast(longer AS decimal(20, 0)) * 100 < cast(a AS decimal(20, 0)) * {within}")
    kept = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(languages, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

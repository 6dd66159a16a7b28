"""Language-model scores by Katz back-off over word pairs.

A text's tokens are its words in lower case and one end; a start that is no token stands before the first. A pair (b, c) of neighbours that the
training texts hold n times, among h uses of b, has the probability d(n) * n / h; d is the Good-Turing discount of small counts. Any other
pair backs off to alpha(b) * p(c), where alpha(b) makes the probabilities of all tokens after b sum to one, and p(c) is
the discounted share of c, or what the discounts of all tokens leave for words never seen.

Tables. ``words``: (w, n, h), how often each word is a token and how often something follows it. ``pairs``: the counts of all pairs, as
sorted arrays by bucket. ``contexts``: (w, h, z, alpha). All of them grow with the training texts; none is held or broadcast as a whole. Words
travel as 64-bit hashes.

A pair belongs to the bucket of its first word, where the word's own counts are too, so that scoring looks up everything of
a token in one place. A word that stands for more than a part of a bucket is spread over several by the other word of the pair, its own counts
with it. A bucket to which more than its share of tokens comes (a line that very many texts hold) is given to several tasks. Texts are never shuffled:
a task sends the pairs of a block of texts at a time to their buckets, what comes back is an array for each block and bucket, and the arrays of
a block are summed in one place. Every text is scored in one of several rounds, by a hash of its row. The requests and arrays of a round
leave the disk before the next one begins, so they never lie there for all texts at once; the tables are sent anew in each round. A round leaves
with each text the words that follow none they were seen after; after the last one, these back off, again by blocks of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, keyed, numbers, partitions, pieces, raw_bytes, real_id, stored, tidy
from mapshelf.llm.words import Words, mix

#: Counts up to this one are discounted.
SMALL = 5
#: Stand-ins for the start and the end of a text, which are no hashes of words.
START, END = np.uint64(1), np.uint64(2)
#: Buckets for each shuffle partition: what a task holds is a quarter of a partition's share.
BUCKETS = 4
#: Bytes of texts whose pairs travel together, pairs that a task counts before it hands them on.
_TEXTS, _HELD = 2 << 20, 1 << 19
#: Rounds in which the texts are scored, one after the other.
ROUNDS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def discounts(counts: dict[int, int], small: int = SMALL) -> dict[int, float]:
    """Good-Turing discount of each count up to the largest limit, ``small`` at most, for which all are above 0 and at most 1.

    ``counts`` has how many things occur once, twice and so on. Without such a limit nothing is discounted.
    """
    for limit in range(small, 0, -1):
        one, over = counts.get(1, 0), (limit + 1) * counts.get(limit + 1, 0)
        if one == 0 or over == 0 or over >= one:
            continue
        common = over / one
        found = {r: ((r + 1) * counts.get(r + 1, 0) / (r * counts[r]) - common) / (1 - common) for r in range(1, limit + 1) if counts.get(r)}
        if len(found) == limit and all(0 < d <= 1 for d in found.values()):
            return found
    return {}


def _discounted(n: np.ndarray, d: dict[int, float]) -> np.ndarray:
    table = np.ones(SMALL + 1)
    for r, x in d.items():
        table[r] = x
    return np.where(n <= SMALL, table[np.minimum(n, SMALL)], 1.0) * n


@dataclass(frozen=True)
class Model:
    """The tables, and the few numbers that belong to all of them."""

    words: DataFrame
    pairs: DataFrame
    contexts: DataFrame
    tokens: int
    vocabulary: int
    texts: int
    word_discounts: dict[int, float]
    pair_discounts: dict[int, float]
    mass: float
    unknown: float
    spread: tuple[np.ndarray, np.ndarray]
    buckets: int

    def share(self, n: np.ndarray) -> np.ndarray:
        """p of tokens that occur n times, or of all that never occur."""
        return np.where(n > 0, _discounted(n, self.word_discounts) / self.mass, self.unknown)


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, second word) of all pairs of neighbours."""
    words = Words(texts, lower=True)
    first = np.insert(words.hash, words.first[:-1], START)
    second = np.insert(words.hash, words.first[1:], END)
    return np.repeat(np.arange(len(texts)), words.counts + 1), first, second


def _lead(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first halves of both words of a pair, by which pairs are sorted."""
    return (b & np.uint64(0xFFFFFFFF << 32)) | (c >> np.uint64(32))


def _order(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """An order of pairs by their leads in which equal ones stand together."""
    lead = _lead(b, c)
    order = np.argsort(lead)
    lead, b, c = lead[order], b[order], c[order]
    odd = np.flatnonzero((lead[1:] == lead[:-1]) & ((b[1:] != b[:-1]) | (c[1:] != c[:-1])))
    if len(odd):  # the few pairs that share their lead with others
        at = np.flatnonzero(np.isin(lead, lead[odd]))
        order[at] = order[at][np.lexsort((c[at], b[at], lead[at]))]
    return order


def _find(lead: np.ndarray, x: np.ndarray, y: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs (b, c) stand among those of (x, y), which are sorted by their leads, and whether they do."""
    if not len(lead):
        return np.zeros(len(b), np.int64), np.zeros(len(b), bool)
    want = _lead(b, c)
    at = np.minimum(np.searchsorted(lead, want), len(lead) - 1)
    there = (x[at] == b) & (y[at] == c)
    miss = np.flatnonzero(~there & (lead[at] == want))
    while len(miss):  # others have the same lead
        miss = miss[at[miss] + 1 < len(lead)]
        miss = miss[lead[at[miss] + 1] == want[miss]]
        at[miss] += 1
        there[miss] = (x[at[miss]] == b[miss]) & (y[at[miss]] == c[miss])
        miss = miss[~there[miss]]
    return at, there


def _summed(b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different pair with its sum, in the order of their leads, that is of the first words."""
    order = _order(b, c)
    b, c, n = b[order], c[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])])) if len(b) else np.zeros(0, np.int64)
    return b[edge], c[edge], np.add.reduceat(n, edge) if len(edge) else n


def _bucket(own: np.ndarray, other: np.ndarray, spread: tuple[np.ndarray, np.ndarray], buckets: int) -> np.ndarray:
    """The bucket of a word, or one of several by the other word where it is spread."""
    hot, parts = spread
    salt = np.zeros(len(own), np.uint64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        some = np.flatnonzero(hot[at] == own)
        salt[some] = mix(other[some]) % parts[at[some]]
    return (((mix(own * _ODD + salt) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _cut(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) for each bucket, keeping the order within it; columns of 32 bits are packed."""
    # Numbers of 16 bits are sorted by their digits.
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    columns = [c[order] for c in columns]
    for a, z in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist()):
        yield int(bucket[a]), *(_packed(c[a:z]) if c.dtype == np.int32 else c[a:z].tobytes() for c in columns)


_ARRAYS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("n", pa.binary()), ("m", pa.binary()), ("k", pa.binary()), ("u", pa.binary())])
_ARRAYS_SQL = "bucket int, kind int, x binary, y binary, n binary, m binary, k binary, u binary"


def _arrays(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (bucket, x, y, n, m, k, u), shorter ones filled up with nulls."""
    filled = [(r[0], kind, *r[1:], *[None] * (7 - len(r))) for r in rows]
    return batch(_ARRAYS, *(list(c) for c in zip(*filled))) if filled else batch(_ARRAYS, *([] for _ in _ARRAYS))


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 32 bits, all lowest bytes first: small ones compress better so."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _i4(data: bytes | None) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data or b"", np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _u8(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint64)


def _i8(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.int64)


def _f8(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.float64)


def _to_tasks(rows: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's rows in one task, kind after kind."""
    return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")


def _count_words(texts: DataFrame) -> DataFrame:
    """(w, n, h) of the training texts."""
    schema = pa.schema([("w", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for part in (p for b in batches for p in pieces(b, "text", _TEXTS)):
            held.append(np.unique(Words(part.column("text"), lower=True).hash, return_counts=True))
            texts += part.num_rows
            if sum(len(w) for w, _ in held) > 2 * _HELD:
                held = [_sums(held)]
                if len(held[0][0]) > _HELD:
                    yield batch(schema, held[0][0].view(np.int64), held[0][1], held[0][1])
                    held = [tuple(c[:0] for c in held[0])]
        known, times = _sums(held)
        yield batch(schema, known.view(np.int64), times, times)
        yield batch(schema, np.array([START, END]).view(np.int64), [0, texts], [texts, 0])

    rows = texts.select("text").mapInArrow(count, "w long, n long, h long")
    return rows.groupBy("w").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).where("n + h > 0")


def _count_pairs(texts: DataFrame, spread: tuple, buckets: int) -> DataFrame:
    """The pairs of the training texts: x, y the words, n the counts, sorted."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for part in (p for b in batches for p in pieces(b, "text", _TEXTS)):
            _, b, c = _pairs(part.column("text"))
            held.append(_summed(b, c, np.ones(len(b), np.int64)))
            if sum(len(x[0]) for x in held) > _HELD:
                held = [_summed(*(np.concatenate(c) for c in zip(*held)))]
                if len(held[0][0]) > _HELD // 2:
                    yield dealt(*held[0])
                    held = [tuple(c[:0] for c in held[0])]
        yield dealt(*_summed(*(np.concatenate(c) for c in zip(*held))))

    def dealt(b: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return _arrays(0, list(_cut(_bucket(b, c, spread, buckets), b, c, n)))

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bucket = [], None
        for part in batches:
            for bucket, x, y, n in zip(*(part.column(c).to_pylist() for c in ("bucket", "x", "y", "n"))):
                if bucket != held_bucket and held:
                    yield total(held_bucket, held)
                    held = []
                held_bucket = bucket
                held.append((_u8(x), _u8(y), _i8(n)))
        if held:
            yield total(held_bucket, held)

    def total(bucket: int, held: list) -> pa.RecordBatch:
        return _arrays(1, [(bucket, *(c.tobytes() for c in _summed(*(np.concatenate(c) for c in zip(*held)))))])

    return _to_tasks(texts.select("text").mapInArrow(count, _ARRAYS_SQL), buckets).mapInArrow(add, _ARRAYS_SQL)


def _spread_rows(rows: DataFrame, spread: tuple, buckets: int, columns: list[str], splits: np.ndarray | None = None) -> DataFrame:
    """Rows of words (first column) as arrays of kind 0, once for each bucket that a word is spread over, and for each task that a bucket is given to."""
    splits = np.ones(buckets, np.int64) if splits is None else splits
    offset = np.cumsum(splits) - splits

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, parts = spread
        for part in batches:
            w = numbers(part.column(0)).view(np.uint64)
            others = [numbers(part.column(i)) for i in range(1, part.num_columns)]
            salts = np.ones(len(w), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
                salts = np.where(hot[at] == w, parts[at].astype(np.int64), 1)
            row = np.repeat(np.arange(len(w)), salts)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(salts) - salts, salts)
            bucket = (((mix(w[row] * _ODD + salt.astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            yield _arrays(0, [(offset[r[0]] + i, *r[1:]) for r in _cut(bucket, w[row], *(o[row] for o in others)) for i in range(splits[r[0]])])

    return rows.select(*columns).mapInArrow(deal, _ARRAYS_SQL)


def _lookup(known: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words stand among sorted ones, and whether they do."""
    if not len(known):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return at, known[at] == words


def _sorted(held: list[tuple]) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*held)]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def _sums(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Each different word with the sum of its numbers."""
    words, n = _sorted(held)
    edge = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    return words[edge], np.add.reduceat(n, edge) if len(edge) else n


def fit(texts: DataFrame, small: int = SMALL, buckets: int | None = None) -> Model:
    """Count the ``text`` column of a table and normalise. A null text has the end alone; an empty table gives a model that knows nothing."""
    buckets = buckets or BUCKETS * partitions(texts.sparkSession)
    words = stored(_count_words(texts), "katz-words")
    seen = words.where("n > 0")
    tokens, vocabulary = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts_n = words.where(F.col("w") == int(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = {r["n"]: r["count"] for r in seen.where(F.col("n") <= small + 1).groupBy("n").count().collect()}
    d1 = discounts(few, small)
    left = sum((1 - x) * r * few[r] for r, x in d1.items())
    mass = float(tokens) if left else tokens + 1.0
    unknown = left / mass if left else 1 / mass
    # Words that stand for more than half a bucket: at most two for each bucket.
    hot = words.select("w", F.greatest("n", "h").alias("n")).where(F.col("n") * 2 * buckets > max(tokens, 1)).collect() if buckets > 1 else []
    hot = sorted((r["w"] & (2**64 - 1), -(-r["n"] * 2 * buckets // max(tokens, 1))) for r in hot)
    spread = np.array([w for w, _ in hot], np.uint64), np.array([p for _, p in hot], np.uint64)
    pairs = stored(_count_pairs(texts, spread, buckets), "katz-pairs")
    few = {r["n"]: r["count"] for r in _few_pairs(pairs, small).groupBy("n").agg(F.sum("times").alias("count")).collect()}
    d2 = discounts(few, small)
    model = Model(words, pairs, words, tokens, vocabulary, texts_n, d1, d2, mass, unknown, spread, buckets)
    contexts = _seen_shares(model).unionByName(_discounted_sums(model)).groupBy("w").agg(F.sum("share").alias("share"), F.sum("total").alias("total"), F.sum("small").alias("small"))
    contexts = contexts.join(words.where("h > 0").select("w", "h"), "w")
    # A context without a discounted count would leave nothing for other tokens: it counts one use more.
    z = F.when(F.col("small") > 0, F.col("h")).otherwise(F.col("h") + 1).cast("double")
    contexts = contexts.withColumn("z", z).select("w", "h", "z", ((1 - F.col("total") / F.col("z")) / (1 - F.col("share"))).alias("alpha"))
    return Model(words, pairs, stored(contexts, "katz-contexts"), tokens, vocabulary, texts_n, d1, d2, mass, unknown, spread, buckets)


def _few_pairs(pairs: DataFrame, small: int) -> DataFrame:
    schema = pa.schema([("n", pa.int64()), ("times", pa.int64())])

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for n in part.column("n").to_pylist():
                n = _i8(n)
                found = np.bincount(n[n <= small + 1], minlength=small + 2)
                yield batch(schema, np.flatnonzero(found), found[found > 0])

    return pairs.select("n").mapInArrow(count, "n long, times long")


def _discounted_sums(model: Model) -> DataFrame:
    """(w, share, total, small): the discounted counts after each word, and how many of them are discounted."""
    schema = pa.schema([("w", pa.int64()), ("share", pa.float64()), ("total", pa.float64()), ("small", pa.int64())])
    d = model.pair_discounts
    less = np.array([r for r, x in d.items() if x < 1], np.int64)

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for x, n in zip(part.column("x").to_pylist(), part.column("n").to_pylist()):
                x, n = _u8(x), _i8(n)
                edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                yield batch(schema, x[edge].view(np.int64), np.zeros(len(edge)), np.add.reduceat(_discounted(n, d), edge), np.add.reduceat(np.isin(n, less).astype(np.int64), edge))

    return model.pairs.select("x", "n").mapInArrow(add, "w long, share double, total double, small long")


def _seen_shares(model: Model) -> DataFrame:
    """(w, share, total, small): the sum of p over the different words seen after w, from the buckets of these words.

    There is one such bucket for each shuffle partition, and a task sends what it holds together, so that rows are few where the pairs are.
    """
    schema = pa.schema([("w", pa.int64()), ("share", pa.float64()), ("total", pa.float64()), ("small", pa.int64())])
    spread, buckets, share = model.spread, _word_buckets(model), _shares(model)
    alone = spread[0][:0], spread[1][:0]

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        b, c = (np.concatenate(x) for x in zip(*held))
        return _arrays(1, list(_cut(_bucket(c, b, spread, buckets), b, c)))

    def returned(held: list[tuple]) -> pa.RecordBatch:
        own, p = (np.concatenate(x) for x in zip(*held))
        return _arrays(0, list(_cut(_bucket(own, own, alone, buckets), own, p)))

    @tidy
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            held.append((_u8(row["x"]), _u8(row["y"])))
            size += len(held[-1][0])
            if size > _HELD:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    @tidy
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for known, (x, y) in _met(batches, ("x", "y")):
            b, c = _u8(x), _u8(y)
            p = share(known[1][_lookup(known[0], c)[0]])
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            held.append((b[edge], np.add.reduceat(p, edge)))
            size += len(edge)
            if size > _HELD:
                yield returned(held)
                held, size = [], 0
        if held:
            yield returned(held)

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(_u8(x), _f8(y)) for part in batches for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
        if held:
            b, p = _sorted(held)
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            yield batch(schema, b[edge].view(np.int64), np.add.reduceat(p, edge), np.zeros(len(edge)), np.zeros(len(edge), np.int64))

    words = _spread_rows(model.words.where("n > 0"), spread, buckets, ["w", "n"])
    pairs = model.pairs.select("x", "y").mapInArrow(turn, _ARRAYS_SQL)
    looked = _to_tasks(words.unionByName(pairs), buckets).mapInArrow(look, _ARRAYS_SQL)
    return looked.repartitionById(buckets, "bucket").mapInArrow(add, "w long, share double, total double, small long")


def _met(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], tuple]]:
    """(words and counts of the bucket, these columns) for each row of a bucket that asks about words."""
    held, known, here = [], None, None
    for part in batches:
        for bucket, kind, x, y, *asked in zip(*(part.column(c).to_pylist() for c in ("bucket", "kind", "x", "y", *columns))):
            if bucket != here:
                held, known, here = [], None, bucket
            if kind == 0:
                held.append((_u8(x), _i8(y)))
                continue
            known = known or (_sorted(held) if held else [np.zeros(0, np.uint64), np.zeros(0, np.int64)])
            yield known, tuple(asked)


def _word_buckets(model: Model) -> int:
    """Buckets of the words alone, of which there are far fewer than pairs: one for each shuffle partition."""
    return max(1, model.buckets // BUCKETS)


def _shares(model: Model):
    """``Model.share`` without the tables, for tasks."""
    d, mass, unknown = model.word_discounts, model.mass, model.unknown
    return lambda n: np.where(n > 0, _discounted(n, d) / mass, unknown)


def _loads(pairs: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket's pairs: one number for each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("load", pa.int64())])

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield batch(schema, part.column("bucket"), [int(_i8(n).sum()) for n in part.column("n").to_pylist()])

    out = np.zeros(buckets, np.int64)
    for r in pairs.select("bucket", "n").mapInArrow(add, "bucket int, load long").groupBy("bucket").agg(F.sum("load").alias("load")).collect():
        out[r["bucket"]] = r["load"]
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, n_tokens, n_known, base_score, score) of each row; k stands for the id.

    ``n_known`` are tokens that the training texts hold, ``base_score`` sums log10((count + 1) / (tokens + vocabulary + 1)) over the tokens, ``score``
    is the model's log10 probability of the text with its end.
    """
    spread, buckets, base = model.spread, model.buckets, float(model.tokens + model.vocabulary + 1)
    loads = _loads(model.pairs, buckets)
    # A bucket of more than twice the mean load is given to several tasks; they are twice the buckets at most.
    splits = np.maximum(1, -(-loads // max(1, 2 * int(loads.sum()) // buckets))).astype(np.int64)
    offset = np.cumsum(splits) - splits
    tasks, d, share = int(splits.sum()), model.pair_discounts, _shares(model)
    end = math.log10((model.texts + 1) / base)

    def turn_of(block: int) -> int:
        """A number by which blocks take turns."""
        return int(mix(np.array([block], np.uint64))[0] >> np.uint64(1))

    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part in (p for b in batches for p in pieces(b, "text", _TEXTS)):
            text, b, c = _pairs(part.column("text"))
            tokens = np.bincount(text, minlength=part.num_rows)
            # Equal pairs of a text come together, but for few that may stand apart: their sums are the same.
            high, low, rest = np.uint64(0xFFFFFF << 40), np.uint64(24), np.uint64(0xFFFF)
            order = np.argsort((b & high) | ((c & high) >> low) | (text.astype(np.uint64) & rest))
            text, b, c = text[order], b[order], c[order]
            edge = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (text[1:] != text[:-1])]))
            times = np.diff(np.append(edge, len(b))).astype(np.int32)
            text, b, c = text[edge], b[edge], c[edge]
            bucket = _bucket(b, c, spread, buckets)
            name, turn = np.int64(block).tobytes(), turn_of(block)
            yield _arrays(2, [(*r, name) for r in _cut(offset[bucket] + turn % splits[bucket], b, c, times, text.astype(np.int32))])
            # The block's ids go along to the place where its arrays are summed.
            yield _arrays(3, [(turn % tasks, numbers(part.column("k")).tobytes(), _packed(tokens), None, None, name)])
            block += 1

    def sums(block: int, text: np.ndarray, score: np.ndarray, known: np.ndarray | None = None, base: np.ndarray | None = None) -> tuple:
        """A row of kind 4: the texts of a block that a bucket has something of, by their distances, and their sums."""
        some = np.flatnonzero(np.bincount(text))
        known, base, score = (None if c is None else np.bincount(text, c)[some] for c in (known, base, score))
        return place_of(block), _packed(np.diff(some, prepend=0)), None if known is None else _packed(known), None if base is None else base.tobytes(), score.tobytes(), np.int64(block).tobytes()

    def place_of(block: int) -> int:
        return turn_of(block) % buckets

    def number(name: bytes) -> int:
        return int(_i8(name)[0])

    @tidy
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row of requests, the sums of its texts (kind 4) and the second words of pairs not seen."""
        here, contexts, pairs, table = None, [], (), None
        for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            if row["bucket"] != here:
                here, contexts, pairs, table = row["bucket"], [], (), None
            if row["kind"] == 0:
                contexts.append((_u8(row["x"]), _i8(row["y"]), _f8(row["n"]), _f8(row["m"])))
                continue
            if row["kind"] == 1:
                x, y = _u8(row["x"]), _u8(row["y"])
                pairs = _lead(x, y), x, y, _i8(row["n"])
                continue
            block = number(row["k"])
            if row["kind"] == 3:
                yield _arrays(3, [(place_of(block), row["x"], row["y"], None, None, row["k"])])
                continue
            if table is None:
                # A last entry that no lookup gives stands in for empty tables.
                nothing = np.array([2**64 - 1], np.uint64)
                table = _sorted([*contexts, (nothing, np.zeros(1, np.int64), np.ones(1), np.ones(1))])
                pairs = pairs or (nothing, nothing, nothing, np.zeros(1, np.int64))
                contexts = []
            b, c = _u8(row["x"]), _u8(row["y"])
            times, text = _i4(row["n"]), _i4(row["m"])
            # What belongs to the first word is looked up once for each run of it.
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            run = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(b))))
            at, used = _lookup(table[0], b[edge])
            h, z, alpha = np.where(used, table[1][at], 0), table[2][at], np.where(used, table[3][at], 1.0)
            token = b[edge] != START  # each word but the end stands first in one pair
            pair, seen = _find(*pairs[:3], b, c)
            p = np.where(seen, _discounted(pairs[3][pair], d) / z[run], alpha[run])
            some = np.flatnonzero(~seen)
            new = c[some].tobytes() + _packed(times[some]) + _packed(text[some])
            yield _arrays(4, [(*sums(block, text, times * np.log10(p), times * (token & (h > 0))[run], times * (token * np.log10((h + 1) / base))[run]), new)])

    found_schema = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("c", pa.binary()), ("times", pa.binary())])

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum what came of the blocks whose place this is: a row for each text, with its words that back off."""
        def ended() -> Iterator[pa.RecordBatch]:
            for ids, tokens, out, new in blocks.values():
                c, times, text = (np.concatenate([x[i] for x in new]) if new else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int32, np.int32)))
                order = np.argsort(text, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(ids) // 8))]).astype(np.int32)
                c, times = (pa.Array.from_buffers(pa.binary(), len(ids) // 8, [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(x[order])]) for x in (c, times))
                yield batch(found_schema, _i8(ids), _i4(tokens), out[0].astype(np.int64), out[1], out[2], c, times)

        here, blocks = None, {}
        for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            if row["bucket"] != here:
                yield from ended()
                here, blocks = row["bucket"], {}
            if row["kind"] == 3:
                blocks[row["k"]] = row["x"], row["y"], np.zeros((3, len(row["x"]) // 8)), []
                continue
            _, _, out, new = blocks[row["k"]]
            text = np.cumsum(_i4(row["x"]))
            for line, values in zip(out, (_i4(row["y"]), _f8(row["n"]), _f8(row["m"]))):
                line[text] += values
            if row["u"]:
                n = len(row["u"]) // 16
                new.append((_u8(row["u"][: 8 * n]), _i4(row["u"][8 * n : 12 * n]), _i4(row["u"][12 * n :])))
        yield from ended()

    @tidy
    def ask_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words that back off, of a block of texts at a time, to their buckets (kind 1), and the texts' sums so far (kind 3)."""
        block = TaskContext.get().partitionId() << 32
        for part in (p for b in batches for p in pieces(b, "c", _TEXTS)):
            (c, ends), (times, _) = raw_bytes(part.column("c")), raw_bytes(part.column("times"))
            c, times = c.view(np.uint64), times.view(np.int32)
            text = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(ends) // 8)
            name, turn = np.int64(block).tobytes(), turn_of(block)
            bucket = _bucket(c, text.astype(np.uint64) + np.uint64(turn), spread, word_buckets)
            yield _arrays(1, [(*r, None, name) for r in _cut(bucket, c, times, text)])
            ids, tokens, *out = (numbers(part.column(i)) for i in range(5))
            yield _arrays(3, [(turn % word_buckets, ids.tobytes(), _packed(tokens), np.concatenate(out).astype(np.float64).tobytes(), None, name)])
            block += 1

    def backed_off(known: list[np.ndarray], asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 4, one for each block that asked about these words."""
        if asked:
            c, times, text, block = (np.concatenate(x) for x in zip(*asked))
            at, there = _lookup(known[0], c)
            values = times * np.log10(share(np.where(there, known[1][at], 0)))
            order = np.argsort(block, kind="stable")
            edge = np.flatnonzero(np.diff(block[order], prepend=-1))
            yield _arrays(4, [sums(int(block[i[0]]), text[i], values[i]) for i in np.split(order, edge[1:]) if len(i)])

    @tidy
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, words, known, asked, size = None, [], None, [], 0
        for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            if row["bucket"] != here or size > _HELD:
                yield from backed_off(known, asked)
                asked, size = [], 0
            if row["bucket"] != here:
                here, words, known = row["bucket"], [], None
            if row["kind"] == 0:
                words.append((_u8(row["x"]), _i8(row["y"])))
            elif row["kind"] == 1:
                known = known or _sorted([*words, (np.array([2**64 - 1], np.uint64), np.zeros(1, np.int64))])
                c = _u8(row["x"])
                asked.append((c, _i4(row["y"]), _i4(row["n"]), np.full(len(c), number(row["k"]))))
                size += len(c)
            else:
                yield _arrays(3, [(0, row["x"], row["y"], row["n"], None, row["k"])])
        yield from backed_off(known, asked)

    schema = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    @tidy
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            block = held.setdefault(row["k"], [None, []])
            if row["kind"] == 3:
                block[0] = _i8(row["x"]), _i4(row["y"]), _f8(row["n"]).reshape(3, -1)
            else:
                block[1].append((row["x"], row["m"]))
        for (ids, tokens, (known, sum_base, sum_score)), found in held.values():
            sum_score = sum_score.copy()
            for text, values in found:
                sum_score[np.cumsum(_i4(text))] += _f8(values)
            yield batch(schema, ids, tokens, known.astype(np.int64) + int(model_texts > 0), sum_base + end, sum_score)

    model_texts, word_buckets = model.texts, _word_buckets(model)
    # The pairs of a bucket go to each of its tasks.
    places = docs.sparkSession.createDataFrame([(i, int(offset[i]) + j) for i in range(buckets) for j in range(splits[i])], "bucket int, task int")
    pairs = model.pairs.join(F.broadcast(places), "bucket").withColumn("bucket", F.col("task")).drop("task")
    rows, parts = keyed(docs, id_col, text_col), []
    for i in range(ROUNDS):
        known = _spread_rows(model.contexts, spread, buckets, ["w", "h", "z", "alpha"], splits).unionByName(pairs)
        asked = rows.where(F.pmod(F.xxhash64("k", "v"), F.lit(ROUNDS)) == i).select("k", "text").mapInArrow(ask, _ARRAYS_SQL)
        found = _to_tasks(known.unionByName(asked), tasks).mapInArrow(answer, _ARRAYS_SQL)
        gathered = _to_tasks(found, buckets).mapInArrow(gather, "k long, n_tokens long, n_known long, base_score double, score double, c binary, times binary")
        parts.append(stored(gathered, "katz-scores"))
    words = _spread_rows(model.words.where("n > 0"), spread, word_buckets, ["w", "n"])
    asked = reduce(DataFrame.unionByName, parts).mapInArrow(ask_again, _ARRAYS_SQL)
    backed = _to_tasks(words.unionByName(asked), word_buckets).mapInArrow(back, _ARRAYS_SQL)
    return stored(backed.repartition("k").mapInArrow(total, "k long, n_tokens long, n_known long, base_score double, score double"), "katz-totals")


def score_held_out(docs: DataFrame, folds: int = 7, fold: int = 2, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents of which the crc32 of the id as text, modulo ``folds``, is not ``fold``, and score all of them.

    One row per row of ``docs``: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` as in ``score``.

    Words are runs of anything but space and 0x09 to 0x0D, with A-Z lower-cased. A null or empty text is its end alone. A null id counts as no
    text, so its row is learned from, and stays null. Repeated rows are learned from and scored each. Texts are read whole, tables may be empty, and other
    columns are left out.
    """
    out = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    model = fit(docs.where(~out).select(F.col(text_col).cast("string").alias("text")), small)
    rows = score(docs, model, id_col, text_col).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    rows = rows.withColumn(id_col, real_id()).select(id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return rows.select(id_col, out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

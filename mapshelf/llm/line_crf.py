"""Quality rules with labelled lines: content or boilerplate.

A linear-chain conditional random field scores each line by its features and each pair of neighbouring lines by a
transition; Viterbi decoding gives the best labels of all lines of a text. The share of words on content lines decides
whether a document stays. Two plain rules come first: too few words, or too many repeated ones.

The field is fitted on a bounded sample of documents with a quality label. Lines of good documents are content.
Lines of bad ones are first told apart by line features alone, and the field is fitted on the labels found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, pieces, tidy
from mapshelf.llm.words import Words, mix, powers, sequence_hash

FEATURES = ("always", "symbols", "upper", "exclaims", "words", "short", "repeated", "duplicate", "sentence", "digits", "long_words")
CONTENT, BOILERPLATE = 0, 1


@dataclass(frozen=True)
class LineField:
    """line: weights of the features for boilerplate (content has 0); step[a, b]: weight of label b after a; first: of the first label."""

    line: np.ndarray
    step: np.ndarray
    first: np.ndarray


#: Used where there are no labels of both kinds to fit on: symbols, capitals and repetition speak for boilerplate.
UNFITTED = LineField(np.array([-3.0, 6, 5, 4, -1, 1, 3, 1, -1, 1, 0]), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``mask`` are set between each bound and the next."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[bounds])


def _seen_before(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a value stood earlier, or anywhere else, among those of the same owner."""
    key = mix(value ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    earlier, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return earlier, twice


class Lines:
    """Counts of texts, and the features of their lines that have a word."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        data, offsets, n = words.data, words.offsets, len(texts)
        starts_char = (data & 0xC0) != 0x80
        in_word = np.zeros(len(data) + 1, np.int8)
        np.add.at(in_word, words.starts, 1)
        np.subtract.at(in_word, words.ends, 1)
        inside = np.cumsum(in_word[:-1]) > 0
        self.n_words = words.counts
        self.word_chars = _sums(inside & starts_char, offsets)
        symbol = _SYMBOL[data]
        self.n_symbols = _sums(symbol, offsets)

        room, triples = words.room(), sequence_hash(words.hash, 3)
        whole = np.flatnonzero(room[: len(triples)] >= 3)
        text = words.text_of()
        _, twice = _seen_before(text[whole], triples[whole])
        covered = np.zeros(len(words.hash) + 3, np.int32)
        np.add.at(covered, whole[twice], 1)
        np.add.at(covered, whole[twice] + 3, -1)
        repeated = np.cumsum(covered)[: len(words.hash)] > 0
        self.n_repeat_words = _sums(repeated, words.first)

        cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
        first_word = np.searchsorted(words.starts, cuts)
        has = np.flatnonzero(np.diff(first_word) > 0)
        begin, end = cuts[:-1], cuts[1:] - (data[cuts[1:] - 1] == 0x0A if len(cuts) > 1 else 0)
        owner = np.searchsorted(offsets, begin, side="right") - 1
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        b, e, self.owner = begin[has], end[has], owner[has]
        value = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        duplicate, _ = _seen_before(self.owner, value)
        self.n_dup_lines = np.bincount(self.owner[duplicate], minlength=n)
        self.first = np.searchsorted(self.owner, np.arange(n + 1))

        def share(mask: np.ndarray) -> np.ndarray:
            return _sums(mask, cuts)[has]

        chars = np.maximum(share(starts_char & inside), 1)
        upper = ((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x80) & (data <= 0x9E) & (np.roll(data, 1) == 0xC3))
        self.words = np.diff(first_word)[has]
        last = data[words.ends[first_word[has + 1] - 1] - 1]
        self.features = np.stack([
            np.ones(len(has)),
            np.minimum(1, 5 * share(symbol) / chars),
            share(upper) / chars,
            np.minimum(1, 5 * share(data == 0x21) / chars),
            np.minimum(self.words, 30) / 30,
            self.words < 4,
            _sums(repeated, first_word)[has] / self.words,
            duplicate,
            np.isin(last, list(b".!?")),
            share((data >= 0x30) & (data <= 0x39)) / chars,
            np.minimum(1, chars / self.words / 20),
        ], axis=1).astype(np.float64)


def viterbi(field: LineField, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labels of each text's lines; ties go to content."""
    score = (features @ field.line).tolist()
    (cc, cb), (bc, bb) = field.step.tolist()
    out = np.zeros(len(features), np.int8)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if a == z:
            continue
        c, b = float(field.first[0]), float(field.first[1]) + score[a]
        back = []
        for s in score[a + 1 : z]:
            to_c, to_b = b + bc > c + cc, b + bb > c + cb
            c, b = (b + bc if to_c else c + cc), (b + bb if to_b else c + cb) + s
            back.append((to_c, to_b))
        label = int(b > c)
        out[z - 1] = label
        for i in range(z - a - 2, -1, -1):
            label = int(back[i][label])
            out[a + i] = label
    return out


def fit(features: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = 80, decay: float = 1e-3) -> LineField:
    """Fit the field on texts with a label each; ``first`` has where the lines of each begin."""
    owner = np.repeat(np.arange(len(good)), np.diff(first))
    bad = ~good[owner]
    if not bad.any() or bad.all():
        return UNFITTED
    weight = np.where(bad, 0.5 / bad.sum(), 0.5 / (~bad).sum()) * len(bad)
    line = np.zeros(features.shape[1])
    m, v = np.zeros_like(line), np.zeros_like(line)
    for i in range(1, 301):
        p = 1 / (1 + np.exp(-features @ line))
        line = _adam(line, features.T @ (weight * (p - bad)) / len(bad) + decay * line, m, v, i)
    label = (bad & (features @ line > 0)).astype(np.int8)

    longest = int(np.diff(first).max())
    at = np.arange(len(owner)) - first[owner]
    x = np.zeros((len(good), longest, features.shape[1]))
    y = np.zeros((len(good), longest), np.int8)
    there = np.zeros((len(good), longest))
    x[owner, at], y[owner, at], there[owner, at] = features, label, 1
    k = features.shape[1]
    theta = np.concatenate([line, np.zeros(6)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair = there[:, 1:]
    counted = np.zeros(6)
    np.add.at(counted, (2 * y[:, :-1] + y[:, 1:]).ravel(), pair.ravel())
    np.add.at(counted, 4 + y[:, 0], there[:, 0])
    seen = np.concatenate([(x * (y * there)[:, :, None]).sum((0, 1)), counted])
    for i in range(1, rounds + 1):
        emit = np.stack([np.zeros(x.shape[:2]), x @ theta[:k]], axis=2)
        step, start = theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, :1] + step[0], ahead[:, t - 1, 1:] + step[1]) + emit[:, t]
            ahead[:, t] = np.where(there[:, t, None] > 0, new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = emit[:, t + 1] + behind[:, t + 1]
            new = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
            behind[:, t] = np.where(there[:, t + 1, None] > 0, new, 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.exp(ahead + behind - whole[:, None, None]) * there[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None, :] - whole[:, None, None, None]) * pair[:, :, None, None]
        expected = np.concatenate([(x * p[:, :, 1:]).sum((0, 1)), both.sum((0, 1)).ravel(), p[:, 0].sum(0)])
        theta = _adam(theta, (expected - seen) / there.sum() + decay * theta, m, v, i)
    return LineField(theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :])


def _adam(theta: np.ndarray, gradient: np.ndarray, m: np.ndarray, v: np.ndarray, i: int, rate: float = 0.1) -> np.ndarray:
    m += 0.1 * (gradient - m)
    v += 0.01 * (gradient**2 - v)
    return theta - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample: int = 600, lines: int = 48, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fit on ``sample`` documents of either label (those of the smallest hashed id), ``lines`` lines of each at most.

    Both bounds hold for fitting only. Labels other than 0 and 1, and ids without a document, are left out.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("good")).where("id IS NOT NULL AND good IN (0, 1)").distinct()
    chosen = None
    for good in (0, 1):
        some = marked.where(F.col("good") == good).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("good", pa.int32()), ("x", pa.binary())])
        for part in (p for b in batches for p in pieces(b, "text")):
            found = Lines(part.column("text"))
            x = [found.features[a : min(z, a + lines)].tobytes() for a, z in zip(found.first[:-1], found.first[1:])]
            yield batch(schema, part.column("id"), part.column("good"), x)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "good", "text").mapInArrow(features, "id long, good int, x binary").collect()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["id"], r["good"], r["x"]))
    if not rows:
        return UNFITTED
    x = [np.frombuffer(r["x"]).reshape(-1, len(FEATURES)) for r in rows]
    return fit(np.concatenate(x), np.cumsum([0, *map(len, x)]), np.array([r["good"] == 1 for r in rows]))


def _verdicts(field: LineField, found: Lines, n: int, min_words: int, most_repeated: float, min_content: float):
    label = viterbi(field, found.features, found.first)
    content = np.bincount(found.owner[label == CONTENT], found.words[label == CONTENT], minlength=n)
    failed = (found.n_words < min_words) | (found.n_repeat_words > most_repeated * found.n_words)
    share = content / np.maximum(found.n_words, 1)
    return label, failed, share, ~failed & (share >= min_content)


def keep_good(docs: DataFrame, field: LineField = UNFITTED, text_col: str = "text", min_words: int = 50, most_repeated: float = 0.5, min_content: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""

    @tidy
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "text")):
            keep = _verdicts(field, Lines(part.column("text")), part.num_rows, min_words, most_repeated, min_content)[3]
            yield pa.RecordBatch.from_arrays([part.column("row").filter(pa.array(keep))], names=["row"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(apply, rows.select("row").schema).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def judge(docs: DataFrame, field: LineField = UNFITTED, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
          most_repeated: float = 0.5, min_content: float = 0.5) -> DataFrame:
    """Counts, line labels and verdict of each document.

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``: characters of ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal
    an earlier one; ``n_repeat_words``: words in 3-word windows that the text has twice or more, the first included; ``base_failed``: fewer
    than ``min_words`` words, or more than ``most_repeated`` of them repeated; ``line_labels``: C or B for each line that has a
    word; ``content_share``: of the words, on content lines; ``kept``: not failed, and a content share of ``min_content`` or more.

    One row per row of ``docs``; rows do not touch one another, so repeated rows and ids get equal results. A null or empty text has no
    words and fails; a null id stays null. Whole texts of any length are read. Other columns are left out.
    """
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_labels", "content_share", "kept"]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.string(), pa.float64(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)))
    letters = np.array([ord("C"), ord("B")], np.uint8)

    @tidy
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "text")):
            found = Lines(part.column("text"))
            label, failed, share, keep = _verdicts(field, found, part.num_rows, min_words, most_repeated, min_content)
            text = letters[label].tobytes().decode()
            marks = [text[a:z] for a, z in zip(found.first[:-1].tolist(), found.first[1:].tolist())]
            yield batch(schema, part.column("id"), found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words,
                        failed, marks, share, keep)

    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = keys.mapInArrow(apply, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                 "base_failed boolean, line_labels string, content_share double, kept boolean")
    return out.withColumnRenamed("id", id_col)

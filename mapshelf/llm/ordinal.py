"""A quality classifier for graded ratings: ordinal cumulative-link regression on hashed text.

One weight vector over hashed features gives a text's score; ordered thresholds cut the scores into grades, the chance of a grade above j being
the logistic curve of the score less threshold j. From these follow the expected grade and the chance of the upper grades, by which documents are selected.

Features are the words (runs of letters and digits, in lower case), the runs of punctuation, and steps of the share of repeated words; each
counts once a text, so one word can decide over a long one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, pieces
from mapshelf.llm.words import Words, mix

SPACE = 1 << 18
_STEPS = 10

_BYTES = np.arange(256)
_LETTER = (_BYTES >= 0x80) | np.isin(_BYTES, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_PUNCTUATION = ~_LETTER & ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class Grader:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """For each score, the chance that the grade is above 0, above 1 and so on."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of the texts, one text after the other, and where each text's begin. An empty text has one of its own."""
    words, marks = Words(texts, lower=True, between=~_LETTER), Words(texts, between=~_PUNCTUATION)
    n = len(texts)
    owner = np.concatenate([words.text_of(), marks.text_of()])
    slot = np.concatenate([words.hash, mix(marks.hash)]) % np.uint64(SPACE - _STEPS - 1) + np.uint64(_STEPS + 1)
    pair = np.unique(owner * SPACE + slot.astype(np.int64))
    own = np.bincount(pair // SPACE, minlength=n)
    total = words.counts + marks.counts
    step = np.where(total > 0, np.minimum(_STEPS - 1, (1 - own / np.maximum(total, 1)) * _STEPS).astype(int), _STEPS)
    pair = np.sort(np.concatenate([pair, np.arange(n) * SPACE + step]))
    return pair % SPACE, np.searchsorted(pair, np.arange(n + 1) * SPACE)


def fit(slots: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 300, rate: float = 0.05, ridge: float = 2e-5, least: int = 5, telling: float = 5.0) -> Grader:
    """Fit on texts with a grade each. All grades weigh the same.

    A feature gets a weight if ``least`` texts have it and its number in some grade is ``telling`` standard deviations or more from what chance gives.
    """
    n = len(grade)
    weights = np.zeros(SPACE, np.float32)
    seen = np.bincount(grade, minlength=grades)
    if n == 0 or np.count_nonzero(seen) < 2:
        return Grader(weights, np.full(grades - 1, 0.0) + np.arange(grades - 1))
    by_grade = np.bincount(slots + SPACE * np.repeat(grade, np.diff(first)), minlength=SPACE * grades).reshape(grades, SPACE)
    share = by_grade.sum(0) / n
    apart = np.abs(by_grade - seen[:, None] * share) / np.sqrt(np.maximum(seen[:, None] * share * (1 - share), 1e-9))
    known = np.flatnonzero((by_grade.sum(0) >= least) & (apart.max(0) >= telling))
    place = np.full(SPACE, -1)
    place[known] = np.arange(len(known))
    row = np.repeat(np.arange(n), np.diff(first))
    on = place[slots] >= 0
    row, column = row[on], place[slots[on]]
    importance = (1 / np.maximum(seen, 1))[grade] / np.count_nonzero(seen)
    theta = np.concatenate([np.zeros(len(known)), [-1.0], np.full(grades - 2, np.log(1.0))])  # first threshold, logs of the steps between
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        w, cut = theta[: len(known)], np.cumsum(np.concatenate([theta[len(known) : len(known) + 1], np.exp(theta[len(known) + 1 :])]))
        score = np.bincount(row, w[column], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -30, 30)))
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        chance = np.maximum((full[:, :-1] - full[:, 1:])[np.arange(n), grade], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        up, down = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]  # of the chance above grade - 1, and above the grade
        by_score = -importance * (up - down) / chance
        by_cut = np.zeros((n, grades + 1))
        by_cut[np.arange(n), grade] += importance * up / chance
        by_cut[np.arange(n), grade + 1] -= importance * down / chance
        by_cut = by_cut.sum(0)[1:-1]
        reach = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(column, by_score[row], minlength=len(known)) + ridge * w, reach[:1], reach[1:] * np.exp(theta[len(known) + 1 :])])
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        theta = theta - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    weights[known] = theta[: len(known)]
    return Grader(weights, np.cumsum(np.concatenate([theta[len(known) : len(known) + 1], np.exp(theta[len(known) + 1 :])])))


def fit_on_ratings(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Grader:
    """Fit on at most ``sample`` rated documents of each grade (those of the smallest hashed id). The bound is for fitting only.

    Ratings without an id, a grade of 0 .. ``grades`` - 1 or a document are left out. With fewer than two grades the weights are 0.
    """
    rated = ratings.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where((F.col("grade") >= 0) & (F.col("grade") < grades) & F.col("id").isNotNull()).distinct()
    chosen = None
    for g in range(grades):
        some = rated.where(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    schema = pa.schema([("id", pa.int64()), ("grade", pa.int32()), ("x", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "text")):
            slots, first = features(part.column("text"))
            data = slots.astype(np.int32).tobytes()
            yield batch(schema, part.column("id"), part.column("grade"), [data[4 * a : 4 * z] for a, z in zip(first[:-1].tolist(), first[1:].tolist())])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "grade", "text").mapInArrow(extract, "id long, grade int, x binary").toArrow()
    rows = sorted(zip(found["id"].to_pylist(), found["grade"].to_pylist(), found["x"].to_pylist()))
    x = [np.frombuffer(r[2], np.int32) for r in rows]
    return fit(np.concatenate([np.zeros(0, np.int32), *x]), np.cumsum([0, *map(len, x)]), np.array([r[1] for r in rows], int), grades)


def grade(docs: DataFrame, grader: Grader, least: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, ``expected_grade``, ``top_probability`` (of the highest grade) and ``kept``: that chance is ``least`` or more.

    One row per row of ``docs``; rows do not touch one another, so repeated rows and ids get equal results. A null or empty text is graded by the
    feature that stands for one; a null id stays null. Texts are read whole; an empty table gives no rows. Other columns are left out.
    """
    schema = pa.schema([("id", pa.int64()), ("expected_grade", pa.float64()), ("top_probability", pa.float64()), ("kept", pa.bool_())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "text")):
            slots, first = features(part.column("text"))
            total = np.concatenate([[0], np.cumsum(grader.weights[slots], dtype=np.float64)])
            above = grader.above(total[first[1:]] - total[first[:-1]])
            yield batch(schema, part.column("id"), above.sum(1), above[:, -1], above[:, -1] >= least)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(apply, "id long, expected_grade double, top_probability double, kept boolean").withColumnRenamed("id", id_col)

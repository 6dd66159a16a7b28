"""Katz back-off against a plain version."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapshelf.llm import katz

SCHEMA = "doc_id long, text string"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


class Plain:
    """The model, its probabilities by recursion."""

    def __init__(self, texts):
        self.pairs, self.words, self.uses = Counter(), Counter(), Counter()
        for t in map(tokens, texts):
            self.words.update(t[1:])
            self.uses.update(t[:-1])
            self.pairs.update(zip(t, t[1:]))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.d1 = katz.discounts(dict(Counter(self.words.values())))
        self.d2 = katz.discounts(dict(Counter(self.pairs.values())))
        self.after = defaultdict(list)
        for (b, c), n in self.pairs.items():
            self.after[b].append((c, n))
        self.mass = self.n if self.d1 else self.n + 1
        self.unknown = 1 - sum(self.d1.get(n, 1) * n for n in self.words.values()) / self.mass

    def one(self, c):
        n = self.words[c]
        return self.d1.get(n, 1) * n / self.mass if n else self.unknown

    def two(self, b, c):
        if b not in self.uses:
            return self.one(c)
        z = self.uses[b] + (not any(self.d2.get(n, 1) < 1 for _, n in self.after[b]))
        n = self.pairs[b, c]
        if n:
            return self.d2.get(n, 1) * n / z
        left = 1 - sum(self.d2.get(n, 1) * n / z for _, n in self.after[b])
        return left / (1 - sum(self.one(x) for x, _ in self.after[b])) * self.one(c)


def brute(rows):
    held = [number is not None and zlib.crc32(str(number).encode()) % 7 == 2 for number, _ in rows]
    model = Plain([t for (_, t), h in zip(rows, held) if not h])
    out = []
    for (number, text), h in zip(rows, held):
        t = tokens(text)
        base = sum(math.log10((model.words[c] + 1) / (model.n + model.v + 1)) for c in t[1:])
        score = sum(math.log10(model.two(b, c)) for b, c in zip(t, t[1:]))
        out.append((number, h, len(t) - 1, sum(model.words[c] > 0 for c in t[1:]), model.n, round(base, 6), round(score, 6)))
    return model, sorted(out, key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    return [(i, " ".join([f"W{int(r.paretovariate(0.8))}" for _ in range(r.randrange(60))] + ["common line here"] * (i % 3 == 0))) for i in range(n)]


def got_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_recursion(spark, seed):
    rows = corpus(seed)
    model, expected = brute(rows)
    assert model.d1 or model.d2
    assert any(h for _, h, *_ in expected)
    assert got_of(katz.score_held_out(spark.createDataFrame(rows, SCHEMA).repartition(4))) == expected


def test_small_pieces_and_hot_words(spark, monkeypatch):
    """Many buckets, so common words are spread and buckets given to several tasks, and pieces of a few texts."""
    monkeypatch.setattr(katz, "BUCKETS", 16)
    monkeypatch.setattr(katz, "_TEXTS", 3000)
    monkeypatch.setattr(katz, "_HELD", 300)
    rows = corpus(5) + [(1000 + i, "the the the cat the the") for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = katz.fit(df.select("text"), buckets=64)
    assert len(model.spread[0]) and model.spread[1].max() > 1
    assert got_of(katz.score_held_out(df)) == brute(rows)[1]


def test_rounds(spark, monkeypatch):
    """Requests of a part of the texts lie on disk at a time, and each text is scored once."""
    scored = []

    def kept(df, label, stored=katz.stored):
        out = stored(df, label)
        scored.extend([out.count()] * (label == "katz-scores"))
        return out

    monkeypatch.setattr(katz, "stored", kept)
    rows = [*corpus(6), *[(1, "again and again")] * 3, *[(None, "again")] * 2, *[(i, "the same line") for i in range(2000, 2300)], (5000, None)]
    assert got_of(katz.score_held_out(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)[1]
    assert len(scored) == katz.ROUNDS and sum(scored) == len(rows) and max(scored) < len(rows) / 2


def test_rows_between_buckets(spark, monkeypatch):
    """A task sends a row to another bucket for a block of texts or for what it holds, not for each bucket that asked."""
    sent = []

    def kept(rows, buckets, to_tasks=katz._to_tasks):
        sent.append((rows, buckets))
        return to_tasks(rows, buckets)

    monkeypatch.setattr(katz, "BUCKETS", 16)
    monkeypatch.setattr(katz, "_to_tasks", kept)
    r = random.Random(7)
    rows = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(120))) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    model = katz.fit(df.where("doc_id < 40").select("text"), buckets=48)
    got = {r.k: r.score for r in katz.score(df, model).collect()}
    plain = Plain([t for _, t in rows[:40]])
    assert all(abs(got[i] - sum(math.log10(plain.two(b, c)) for b, c in zip(tokens(t), tokens(t)[1:]))) < 1e-6 for i, t in rows)
    counts = [(rows.where("kind > 0").count(), buckets) for rows, buckets in sent]
    assert len(counts) == 3 + 2 * katz.ROUNDS
    # The pairs as they are counted, their second words, requests and answers of two blocks in each round, and words that back off.
    assert all(n <= 4 * (buckets + 1) for n, buckets in counts[:1] + counts[2:-1])
    assert counts[1][0] <= spark.sparkContext.defaultParallelism * counts[1][1] and counts[1][1] == 3
    assert counts[-1][1] == 3 and counts[-1][0] <= 4 * 2 * katz.ROUNDS * 2


def test_leads_that_agree():
    """Pairs whose halves agree with others are counted and found apart."""
    r = np.random.default_rng(3)
    b, c = (r.integers(0, 4, 5000).astype(np.uint64) << np.uint64(32) | r.integers(0, 3, 5000).astype(np.uint64) for _ in "bc")
    plain = Counter(zip(b.tolist(), c.tolist()))
    x, y, n = katz._summed(b, c, np.ones(len(b), np.int64))
    assert {(i, j): k for i, j, k in zip(x.tolist(), y.tolist(), n.tolist())} == plain and len(x) == len(plain)
    known = slice(0, None, 2)
    x, y, n = x[known], y[known], n[known]
    at, there = katz._find(katz._lead(x, y), x, y, b, c)
    own = set(zip(x.tolist(), y.tolist()))
    assert there.tolist() == [p in own for p in zip(b.tolist(), c.tolist())]
    assert (x[at[there]] == b[there]).all() and (y[at[there]] == c[there]).all()
    assert not katz._find(katz._lead(x[:0], y[:0]), x[:0], y[:0], b, c)[1].any()


def test_packed():
    for values in ([], [0], [3, 2**31 - 1, 0, 70_000, 255]):
        assert katz._i4(katz._packed(np.array(values, np.int32))).tolist() == values


def test_probabilities_sum_to_one():
    model = Plain([t for _, t in corpus(3, 120)])
    for b in ["<s>", "w1", "w2", *list(model.uses)[:20], "never"]:
        total = sum(model.two(b, c) for c in model.words) + model.two(b, "never seen")
        assert abs(total - 1) < 1e-9


def test_discounts():
    assert katz.discounts({1: 100, 2: 40, 3: 22, 4: 14, 5: 10, 6: 7}).keys() == {1, 2, 3, 4, 5}
    assert all(0 < d <= 1 for d in katz.discounts({1: 100, 2: 40, 3: 22, 4: 14, 5: 10, 6: 7}).values())
    assert katz.discounts({1: 100, 2: 20, 3: 4}).keys() <= {1, 2}
    assert katz.discounts({}) == katz.discounts({1: 5}) == katz.discounts({2: 5, 3: 1}) == {}
    assert np.allclose(katz._discounted(np.array([0, 1, 2, 9]), {1: 0.5}), [0, 0.5, 2, 9])


def test_edges(spark):
    rows = [(None, "a b a"), (None, "a b a"), (1, None), (2, ""), (2, "x " * 60_000), (9, "a new one"), (9, "a new one")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit(1)).withColumn("n", F.lit("x"))
    assert got_of(katz.score_held_out(df)) == brute(rows)[1]
    assert katz.score_held_out(spark.createDataFrame([], SCHEMA)).count() == 0
    # Nothing to learn from: every token is unknown.
    only = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = katz.score_held_out(spark.createDataFrame([(i, "a b") for i in only], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(3, 0, 0, 0.0)] * 2

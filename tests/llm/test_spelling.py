"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mapshelf.llm import spelling

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least=5, often=3, times=2):
    count = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= least and n >= often}
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= times * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items()}


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(4, 9))) for _ in range(60)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "abaaa", "aabaa", "Straße", "ÀÉÎõü", "ÀÉÎõ÷x"]
    rows = []
    for i in range(400):
        text = []
        for _ in range(40):
            w = list(r.choice(words[: 1 + int(len(words) * r.random() ** 3)] if r.random() < 0.7 else words))
            if r.random() < 0.3 and len(w) > 1:
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = r.choice(["a", "b", "é", ""])
            text.append("".join(w).title() if r.random() < 0.2 else "".join(w))
        rows.append((i, r.choice([" ", ", ", "-1"]).join(text)))
    return rows


def got_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed,parts,most", [(1, 8, 64), (2, 4, 2)])
def test_against_brute_force(spark, seed, parts, most):
    """With four parts and a low bound, nearly all signatures are refined by halves."""
    rows = corpus(seed)
    expected = brute(rows)
    assert got_of(spelling.group(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=parts, most=most)) == expected
    assert any(f and expected[f][0] for f, *_ in expected.values())  # a way of two steps


def test_many_words_of_one_multiset(spark):
    """Words of the same letters share every signature; only neighbours are linked."""
    from itertools import permutations
    words = sorted({"".join(p) for p in permutations("aabbcc")})
    rows = [(1, " ".join(words + words + words)), (2, " ".join(["aabbccd"] * 9))]
    assert got_of(spelling.group(spark.createDataFrame(rows, SCHEMA), most=4)) == brute(rows)


def test_edges(spark):
    rows = [(None, "Hello hello hellp"), (None, "Hello hello hellp"), (3, None), (3, ""), (4, "12 _ x"), (5, "hello " * 50_000 + "hellp"), (5, "hello")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("x")).withColumn("n", F.lit(7))
    assert got_of(spelling.group(df)) == brute(rows)
    assert spelling.group(spark.createDataFrame([], SCHEMA)).count() == 0

"""Collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapshelf.llm import phrases

SCHEMA = "doc_id long, lang string, text string"


def brute(rows, least=30, longest=4, within=80, top=2000):
    f, total = Counter(), Counter()
    for _, lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: n for p, n in f.items() if len(p) > 2 and n >= least}
    kept = []
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * n >= within * a and any(q[i : i + len(w)] == w for i in range(1, len(q))) for q, n in cand.items()):
            continue
        score, cut = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        kept.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:cut]], f[lang, *w[cut:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return out


def corpus(seed, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "über", "x-1", "#"]
    fixed = ["new york city hall", "in spite of", "w1 w2 w3", "Big Apple", "a a a a a"]
    rows = []
    for i in range(n):
        some = [r.choice(fixed) if r.random() < 0.25 else r.choice(words) for _ in range(r.randrange(40))]
        rows.append((i, r.choice(["en", "en", "de", None]), "".join(w + r.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for w in some)))
    return rows


def got_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed,size,longest", [(1, 1 << 18, 4), (2, 300, 4), (3, 50, 3)])
def test_against_brute_force(spark, seed, size, longest):
    """Also where a shard holds far fewer words than a phrase has to occur."""
    rows = corpus(seed)
    expected = brute(rows, longest=longest)
    assert len(expected) > 20
    assert got_of(phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(6), size=size, longest=longest)) == sorted(expected)


def test_top_of_each_language(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_of(phrases.collocations(df, top=5)) == sorted(brute(rows, top=5))


def test_index_extends_to_both_sides():
    """Intervals and counts of all phrases of a sequence, found by growing, are those of a plain count."""
    r = np.random.default_rng(1)
    ids = np.concatenate([[0], r.integers(0, 6, 500), [3, 3, 3, 3, 3]]).astype(np.int32)
    sides = [phrases._transform(x, 4) for x in (ids, ids[::-1])]
    assert all((phrases._unpacked(phrases._packed(s)) == s).all() for s in sides)
    index = phrases.Index(np.arange(11, 16, dtype=np.uint64), np.bincount(ids, minlength=6)[1:], *sides)
    some = index.words()
    for k in range(2, 5):
        some = index.grown(some)
        plain = Counter(tuple(ids[i : i + k]) for i in range(len(ids) - k + 1) if (ids[i : i + k] > 0).all())
        assert dict(zip(map(tuple, some.ids.tolist()), some.n.tolist())) == plain


def test_words_of_pieces():
    sequence, known, words = phrases._sequence(pa.array(["A b.c", None, "", " , ", "a\tb"]))
    assert (sequence == 0).tolist() == [True, False, False, True, False, True, False, False] and sorted(words) == [b"a", b"b", b"c"]


def test_edges(spark):
    rows = [(None, None, "Ab cd. " * 40), (1, "en", None), (1, "en", ""), (2, "en", ", ; ."), (3, "und", "ab cd " * 20_000), (3, "xx", "ab cd " * 10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x"))
    assert got_of(phrases.collocations(df)) == sorted(brute(rows))
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0

import random

import brute
import pytest
from pyspark.sql import functions as F

from mapshelf.llm import graph, minhash

SCHEMA = "doc_id long, text string"


def edited(r, words, rate):
    return [w if r.random() > rate else f"e{r.randrange(10**6)}" for w in words]


def near_corpus(seed, n_groups=12, group=9, length=(8, 260)):
    r = random.Random(seed)
    rows, line = [], [f"l{i}" for i in range(14)]
    for _ in range(n_groups):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(*length))]
        for _ in range(r.randrange(1, group)):
            rows.append(edited(r, base, r.choice([0, 0.01, 0.03, 0.06])) + (line if r.random() < 0.5 else []))
    rows += [[f"v{r.randrange(4000)}" for _ in range(r.randrange(1, 60))] + line for _ in range(40)]
    rows += [list("abc"), list("ABC"), list("ab"), ["a"], []]
    r.shuffle(rows)
    return [(2 * i + 1, " ".join(w)) for i, w in enumerate(rows)] + [(10**6, None)]


@pytest.mark.parametrize("seed,size,rare", [(1, 4, 8), (2, 5, 2), (3, 4, 1)])
def test_against_brute_force(spark, seed, size, rare):
    """A low bound on rare values makes most lists common ones."""
    rows = near_corpus(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size, rare=rare).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_around_a_template(spark):
    """Copies that are near the template only, not one another."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(r, base, 0.035))) for i in range(60)] + [(100, " ".join(base))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_duplicates(rows, 4)


def test_noisy_group(spark, monkeypatch):
    """Copies of one text with 1 to 8 % of edits: many stay outside the largest component, and what is compared grows with their number."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(r, base, r.uniform(0.01, 0.08)))) for i in range(160)]
    dealt = []
    families = minhash._families
    monkeypatch.setattr(minhash, "_families", lambda *a: dealt.append(families(*a)) or dealt[-1])
    for block in (256, 7):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_duplicates(rows, 4)
    assert 0 < dealt[0].count() <= 2 * len(rows)


def test_very_long_text(spark):
    """A text of 200,000 words, an edited copy of it and one of its first half."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**5)}" for _ in range(200_000)]
    rows = [(1, " ".join(base)), (2, " ".join(edited(r, base, 0.01))), (3, " ".join(base[:100_000]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 1), (3, 3)]


def test_edges(spark):
    rows = [(None, "x y z a b"), (4, "x y z a b"), (4, "x y z a b"), (7, None), (7, " "), (8, "q r s")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("class", F.lit(1)).withColumn("k", F.lit(2))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (4, 1, None, False), (4, 1, None, False), (7, 0, 7, True), (7, 0, 7, True), (8, 1, 8, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(3, 3), (None, 4)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [(a, b) for a, b in links if a is not None and a != b]
    nodes = sorted({x for p in links for x in p})
    assert got == brute.components(nodes, links)

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from mapshelf.llm import mixing
from mapshelf.llm.mixing import Mix

SCHEMA = "doc_id long, text string, source string"


def table(spark):
    rows = [(d, t, ["a", "b", "B", None, "é", "z"][d % 6] if d % 7 else "a") for d, t in brute.corpus(3, 300)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_targets():
    assert mixing.targets([100, 100, 100], Mix()) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([], Mix()) == [] and mixing.targets([0, 0], Mix()) == [0, 0]
    assert sum(mixing.targets([1000, 1, 3, 50], Mix())) == pytest.approx(1581)


def test_permutation():
    for n in (1, 2, 3, 64, 65, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, np.full(n, 7, np.uint64))) == list(range(n))
    assert (mixing.permuted(np.arange(1000), 1000, np.full(1000, 7, np.uint64)) != np.arange(1000)).mean() > 0.9


def test_draw_meets_totals():
    got = Counter()
    for _, s, first, n in mixing.draw([1000, 0, 37, 5000], Mix(shard=100)):
        assert first == got[s]
        got[s] += n
    assert got == {0: 1000, 2: 37, 3: 5000}


def test_plan(spark):
    rows, df = table(spark)
    mix = Mix(block=4, shard=64)
    got = mixing.plan(df, mix).collect()
    size = {d: len(brute.WORD.findall(t or "")) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    words, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source == source[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        assert r.taken == sum((x.stop - x.start) * x.times for x in r.runs or [])
        words[r.source] += r["size"]
        taken[r.source] += r.taken
    names = sorted(words, key=lambda x: (x is None, x or ""))
    wanted = dict(zip(names, mixing.targets([words[n] for n in names], mix)))
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(wanted[r.source])
    for n in names:
        assert abs(taken[n] - wanted[n]) <= 2 * mix.block
    again = {(r.doc_id, r.taken) for r in mixing.plan(df.repartition(7), mix).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_texts_hold_the_words_of_the_plan(spark):
    rows, df = table(spark)
    rows += rows[:20] + [(None, "no id here", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit(1)).withColumn("runs", F.lit("x"))
    mix = Mix(block=4, shard=64)
    planned = Counter()
    for r in mixing.plan(df, mix).collect():
        planned[r.doc_id] += r.taken
    out = mixing.mixed_texts(df, mix)
    assert out.columns == df.columns
    got, texts = Counter(), defaultdict(set)
    for r in out.collect():
        got[r.doc_id] += len(brute.WORD.findall(r.text))
        texts[r.doc_id].add(r.text)
        assert r.k == 1 and r.runs == "x"
    assert +planned == got
    for d, t, _ in rows:
        known = Counter(brute.WORD.findall(t or ""))
        assert all(not Counter(brute.WORD.findall(x)) - known for x in texts.get(d, ()))


def test_empty_and_single(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_texts(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0
    row = mixing.plan(spark.createDataFrame([(1, "a b", None), (2, None, None)], SCHEMA)).orderBy("doc_id").collect()
    assert [(r["size"], r.source_size, r.target) for r in row] == [(2, 2, 3.0), (0, 2, 3.0)] and row[0].taken in (2, 4)


def test_the_mix_follows_the_draw(spark):
    rows, df = table(spark)
    mix = Mix(block=4, shard=64)
    got = mixing.mixed(df, mix).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(len(shards))) and len(shards) > 3
    names = sorted({s for _, _, s in rows}, key=lambda x: (x is None, x or ""))
    slots = Counter(r.source for r in got)
    drawn = {(shard, names[s]): n for shard, s, _, n in mixing.draw([slots[n] for n in names], mix)}
    assert Counter((r.shard, r.source) for r in got) == drawn
    for some in shards.values():
        some.sort(key=lambda r: r.slot)
        assert [r.slot for r in some] == list(range(len(some)))
    assert [r.source for r in shards[0]] != sorted((r.source for r in shards[0]), key=lambda x: (x is None, x or ""))
    taken = Counter()
    for r in got:
        assert 0 < sum(x.stop - x.start for x in r.runs) <= mix.block
        for x in r.runs:
            taken[x.doc_id] += x.stop - x.start
    assert taken == {r.doc_id: r.taken for r in mixing.plan(df, mix).collect() if r.taken}
    again = mixing.mixed(df.repartition(7), mix).collect()
    assert sorted((r.shard, r.slot, r.source or "", r.block) for r in again) == sorted((r.shard, r.slot, r.source or "", r.block) for r in got)

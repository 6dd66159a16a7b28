import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapshelf.llm import substring
from mapshelf.llm.common import batch
from mapshelf.llm.words import Words

SCHEMA = "doc_id long, text string"


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


@pytest.mark.parametrize("size", [5, 20])
@pytest.mark.parametrize("hot", [16, 0.02])
def test_against_brute_force(spark, monkeypatch, size, hot):
    """A low bound on bucket sizes sends most buckets through the second round."""
    monkeypatch.setattr(substring, "HOT", hot)
    rows = brute.corpus(size, 150)
    if hot < 1:
        rows += [(10**6 + i, "a common line of words that stands in every one of them " + str(i) + " and a tail " * 9) for i in range(200)]
    got = result(substring.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), size=size, gram=1 + (size == 5)))
    assert got == brute.substring(rows, size)


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (7, " ".join("abc")), (8, None), (9, text + " " + text)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit("x")).withColumn("start", F.lit(1)).withColumn("words", F.lit(None).cast("string"))
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()))
    assert got == [(0, 40, 0), (5, 40, 40), (5, 40, 40), (7, 1, 0), (8, 0, 0), (9, 80, 80)]


def test_repeated_row_is_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring.remove_repeats(spark.createDataFrame([(1, text), (1, text)], SCHEMA)).collect()
    assert [(r.n_removed, r.kept_text) for r in got] == [(0, text)] * 2


def test_empty_table_and_long_text(spark):
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"n{i}" for i in range(400_000))
    got = result(substring.remove_repeats(spark.createDataFrame([(1, long), (2, "x " + long[-5000:])], SCHEMA)))
    assert got[1][:2] == (400_000, 0) and got[2][1] >= got[2][0] - 2


def test_windows_of_more_than_255_words(spark):
    """One long word in a text of short ones is the minimiser of all windows that hold it."""
    short = lambda d: [f"{d}{i}" for i in range(400)]
    passage = [*(f"s{i}" for i in range(330)), "a-long-word", *(f"t{i}" for i in range(330))]
    rows = [(d, " ".join([*short("abc"[d]), *passage, *short("xyz"[d])])) for d in range(3)]
    for size in (256, 300):
        got = result(substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), size=size))
        assert got == brute.substring(rows, size)
        assert got[1][1] == len(passage)


def test_bucket_of_a_common_word_is_parted(spark, monkeypatch):
    """Texts that share one long word only: no window of theirs goes on to a second round, which would write each with all of its words."""
    rows = [(d, " ".join([*(f"a{d}x{i}"[:5] for i in range(19)), "longest-of-words", *(f"b{d}x{i}"[:5] for i in range(19))])) for d in range(100, 700)]
    rows += [(d + 1000, text) for d, text in rows[::50]]
    seen = []
    monkeypatch.setattr(substring, "stored", lambda df, label: seen.append(df.cache()) or seen[-1])
    got = result(substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute.substring(rows, 20)
    assert seen[0].where("key IS NULL").count() and seen[0].where("key IS NOT NULL").isEmpty()


@pytest.mark.parametrize("size, gram", [(20, 1), (3, 3)])
def test_buckets_hold_all_of_a_window(size, gram):
    """Parted or not, equal windows have one bucket, and each window is in one super-k-mer."""
    words = Words(pa.array([t for _, t in brute.corpus(size, 60)]))
    text = [words.data[a:z].tobytes() for a, z in zip(words.starts, words.ends)]
    for large in (None, np.ones(7, bool), np.arange(7) % 2 == 0):
        key, first, n, parted = substring._super_kmers(words, size, gram, large)
        assert parted.all() if large is not None and large.all() else large is not None or not parted.any()
        bucket = {}
        for k, i in ((k, i) for k, a, m in zip(key.tolist(), first.tolist(), n.tolist()) for i in range(a, a + m)):
            assert bucket.setdefault(tuple(text[i : i + size]), k) == k
        assert sorted(i for a, m in zip(first, n) for i in range(a, a + m)) == np.flatnonzero(words.room() >= size).tolist()


def test_a_large_bucket_needs_few_bytes_a_window():
    """The words of a bucket are not looked at all at once."""
    texts = [" ".join(f"{i * 31 % 997}{j % 7} {j}" for j in range(15)) for i in range(40_000)]
    head = np.zeros(len(texts), substring._HEAD)
    head["k"], head["n"] = np.arange(len(texts)), 11
    part = batch(substring._GRAMS, np.zeros(len(texts), np.int32), substring._packed(head, " ".join(texts).encode(), *places(texts)))
    tracemalloc.start()
    found = sum(p.num_rows for p in substring._repeats(part, 20))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(texts) - 997
    assert most < 10 * part.nbytes


def places(texts):
    ends = (np.cumsum([len(t) + 1 for t in texts]) - 1).tolist()
    return [z - len(t) for t, z in zip(texts, ends)], ends

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from mapshelf.llm import line_crf

SCHEMA = "doc_id long, text string"


def texts():
    r = random.Random(2)
    rows = brute.corpus(5, 80, vocabulary=6)
    for i in range(60):
        lines = [" ".join(r.choice(["ab", "Cé", "d#", "*", "|", "日本", "e$%", "f<>&"]) for _ in range(r.randrange(0, 9))) + r.choice(["", "\r", " "]) for _ in range(r.randrange(0, 20))]
        rows.append((5000 + i, "\n".join(lines)))
    return rows


def test_counts(spark):
    rows = texts()
    got = {r.doc_id: r for r in line_crf.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, t in rows:
        n, chars, symbols, lines, repeated = brute.quality_counts(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.base_failed and r.kept)
        assert len(r.line_labels) == sum(bool(brute.WORD.search(x)) for x in (t or "").split("\n"))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        field = line_crf.LineField(rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(n, 2))

        def score(path):
            s = field.first[path[0]] + sum(x[i] @ field.line for i in range(n) if path[i])
            return s + sum(field.step[a, b] for a, b in zip(path, path[1:]))

        best = max((tuple(i >> j & 1 for j in range(n)) for i in range(2**n)), key=score)
        assert tuple(line_crf.viterbi(field, x, np.array([0, n]))) == best


def test_held_out_documents(spark, sf_dir):
    """Fitted on some labelled documents, it keeps the good and drops the bad among the others."""
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = line_crf.fit_on_labels(docs.where("doc_id % 2 = 0"), labels)
    out = line_crf.judge(docs.where("doc_id % 2 = 1"), field).where("not base_failed").join(labels, "doc_id")
    kept = {r.quality: r.kept for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_edges(spark):
    text = "A plain line of words that ends here.\n" * 1 + " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(None, text), (1, None), (1, ""), (2, text), (2, text), (3, "\n\n \n"), (4, " ".join(f"n{i}" for i in range(300_000)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("kept", F.lit(5))
    got = line_crf.judge(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 68, True), (1, 0, False), (1, 0, False), (2, 68, True), (2, 68, True), (3, 0, False), (4, 300_000, True)]
    assert line_crf.judge(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("labels", [[], [(2, 1)], [(2, None), (None, 0), (2, 7)]])
def test_without_labels_of_both_kinds(spark, labels):
    docs = spark.createDataFrame([(2, "some text"), (3, None)], SCHEMA)
    assert line_crf.fit_on_labels(docs, spark.createDataFrame(labels, "doc_id long, quality int")) is line_crf.UNFITTED

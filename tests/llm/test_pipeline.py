"""Each stage on what the one before kept, against a plain version."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mapshelf.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string"


def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choice(["er", "tion", "sa", "lo", "mi", "ten"]) for _ in range(r.randrange(1, 4)))
    shared = " ".join(word() for _ in range(45))
    texts, quality = [], []
    for i in range(150):
        lines = [" ".join(word() for _ in range(r.randrange(8, 20))) + "." for _ in range(r.randrange(5, 15))]
        if i % 4 == 0:
            lines.insert(2, shared)
        if i % 5 == 0:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) + " $$$ ***" for x in lines]
        texts.append("\n".join(lines))
        quality.append(int(i % 5 != 0))
    for i in (1, 2, 3, 6, 7, 11):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts += [texts[i], " ".join(words)]
        quality += [1, 1]
    rows = [(i * 3 + 2, t, "en", f"src{i % 4}" if i % 9 else None, len(t), "x") for i, t in enumerate(texts)]
    return rows + [(9001, None, None, None, None, None), (9002, "", "en", "src1", 0, None)], [(i * 3 + 2, q, 0) for i, q in enumerate(quality)]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows after each stage, the input first."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert name == "best_fit_packing" or docs.columns == columns
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, out[-1]), key=str)
    return out


def test_quality_rules(kept):
    quality = {d: q for d, q, _ in corpus()[1]}
    good = {r.doc_id for r in kept[1]}
    for r in kept[0]:
        n, _, _, _, repeated = brute.quality_counts(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert r.doc_id not in good
        elif quality[r.doc_id]:
            assert r.doc_id in good
    assert sum(not quality[d] for d in good) <= 2
    assert {r.doc_id: r for r in kept[0] if r.doc_id in good} == {r.doc_id: r for r in kept[1]}


def test_near_dedup(kept):
    groups = brute.near_duplicates([(r.doc_id, r.text) for r in kept[1]], 5)
    assert {r.doc_id for r in kept[2]} == {d for d, (_, c) in groups.items() if d == c} and len(kept[2]) < len(kept[1])


def test_substring_dedup(kept):
    wanted = brute.substring([(r.doc_id, r.text) for r in kept[2]], 20)
    before = {r.doc_id: r.text for r in kept[2]}
    assert len(kept[3]) == len(kept[2]) and any(n for _, n, _ in wanted.values())
    for r in kept[3]:
        _, removed, text = wanted[r.doc_id]
        assert r.text == (text if removed else before[r.doc_id]) and r.n_chars == len(r.text)


def test_source_mix(kept):
    words = Counter(), Counter()
    texts = {r.doc_id: Counter(brute.WORD.findall(r.text)) for r in kept[3]}
    for part, rows in zip(words, (kept[3], kept[4])):
        for r in rows:
            part[r.source] += len(brute.WORD.findall(r.text))
    for r in kept[4]:
        assert not Counter(brute.WORD.findall(r.text)) - texts[r.doc_id]
    assert max(Counter(r.doc_id for r in kept[4]).values()) <= 2
    assert abs(sum(words[1].values()) - 1.5 * sum(words[0].values())) <= 64 * len(words[0])


def test_packing(kept):
    tokenizer = Tokenizer.from_file(default_path())
    wanted = Counter(zlib.crc32(np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in kept[4])
    assert Counter(r.ids_crc32 for r in kept[5] if r.length < 2048) == wanted
    assert len({(r.sequence_id, r.offset) for r in kept[5]}) == len(kept[5])

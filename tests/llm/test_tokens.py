import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapshelf.llm import packing, token_store
from mapshelf.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_units_give_the_ids_of_whole_texts(tokenizer):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "a", "B", "é", "日", "1", ".", "'s", "<|endoftext|>", "\r", "​", "᠎", "　", "😀", "_", "-"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(5000)] + ["", " ", " a", "a ", " a b "]
    found = Encoder(default_path(), memory=1000).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def rows():
    r = random.Random(1)
    return brute.corpus(8, 120) + [(50_000 + i, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([3, 400, 1500, 9000])))) for i in range(30)]


def test_store_round_trip(spark, tmp_path, tokenizer):
    docs = rows() + [(None, "no id")]
    token_store.write(spark.createDataFrame(docs, SCHEMA).repartition(4).withColumn("ids", F.lit(1)), f"{tmp_path}/orc")
    read = token_store.read(spark, f"{tmp_path}/orc")
    got = {r.doc_id: r for r in token_store.checksums(read).collect()}
    before = 0
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        ids = ids_of(tokenizer, text, 2)
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    one = docs[5]
    assert [np.array(r.ids).tolist() for r in read.where(F.col("doc_id") == one[0]).collect()] == [ids_of(tokenizer, one[1], 2).tolist()]
    files = [sorted(r.doc_id for r in spark.read.schema(token_store.COLUMNS).orc(str(f)).where("doc_id IS NOT NULL").collect()) for f in sorted((tmp_path / "orc").glob("part-*"))]
    flat = [x for f in files for x in f]
    assert flat == sorted(flat)


def test_store_of_repeated_rows_and_none(spark, tmp_path):
    token_store.write(spark.createDataFrame([(1, "a"), (1, "a"), (1, None)], SCHEMA), f"{tmp_path}/a")
    got = token_store.read(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 1, 1] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    token_store.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/b")
    assert token_store.checksums(token_store.read(spark, f"{tmp_path}/b")).count() == 0


def test_best_fit_picks_the_tightest_and_closes_the_fullest():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (1, 8)]
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (9, 8, 7)] == [(0, 0), (1, 0), (2, 0)] and bins.open == 2
    assert bins.place(1) == (1, 8)  # sequence 0, the fullest, is closed


def test_pack(spark, tokenizer):
    docs = rows()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3).withColumn("start", F.lit("x"))
    got = packing.pack(df)
    pieces = got.collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    total = 0
    for doc, text in docs:
        ids, at = ids_of(tokenizer, text, 0), 0
        total += len(ids)
        for i, p in enumerate(sorted(by_doc.pop(doc), key=lambda p: p.piece)):
            assert (p.piece, p.start) == (i, at) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            assert p.length == 2048 or i == 0
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) * 1.05 + 1
    assert sorted(map(tuple, packing.pack(df).collect()), key=str) == sorted(map(tuple, pieces), key=str)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(df, got).collect()}
    for p in pieces:
        assert zlib.crc32(whole[p.sequence_id][p.offset : p.offset + p.length].tobytes()) == p.ids_crc32


def test_pack_edges(spark):
    got = packing.pack(spark.createDataFrame([(None, None), (1, ""), (1, "")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 1), (1, 0, 1), (1, 0, 1)] and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0

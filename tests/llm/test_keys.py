"""Rows that share an id: documents of their own, whatever their texts."""

import pytest
from pyspark.sql import functions as F

from mapshelf.llm import minhash, mixing, substring
from mapshelf.llm.tokens import Encoder, default_path


def text(number: int) -> str:
    return " ".join(f"word{number}x{i}" for i in range(60))


@pytest.fixture(scope="module")
def colliding(spark):
    """Two texts whose 32-bit hashes are equal."""
    numbers = spark.range(200_000).select("id", F.hash(F.concat_ws(" ", *(F.concat(F.lit("word"), F.col("id"), F.lit(f"x{i}")) for i in range(60)))).alias("h"))
    a, b = numbers.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").orderBy("a").select("a", "b").first()
    return text(a), text(b)


def test_equal_short_hashes_are_not_one_document(spark, colliding):
    a, b = colliding
    half = " ".join(b.split()[:30])
    docs = spark.createDataFrame([(-5, half, "s"), (7, a, "s"), (7, b, "s"), (None, a, "s"), (None, b, "s")], "doc_id long, text string, source string")
    removed = {(r.doc_id, r.n_removed) for r in substring.remove_repeats(docs).collect()}
    assert removed == {(-5, 30), (7, 60), (None, 0)}  # a null id comes first
    groups = minhash.near_duplicates(docs.where("doc_id = 7")).select("class_id").distinct().count()
    assert groups == 2
    assert sorted(r["size"] for r in mixing.plan(docs.where("doc_id = 7")).collect()) == [60, 60]
    only = docs.where("doc_id IS NOT NULL")
    kept = {r.kept_text for r in substring.remove_repeats(only.where("doc_id = 7 OR doc_id = -5")).collect() if r.doc_id == 7}
    assert kept == {a, " ".join(b.split()[30:])}


def test_encoder_memory_does_not_change_ids():
    texts = [" ".join(f"Wört{i * k}." for i in range(50)) + "\n\n  end <|endoftext|> Ġx" for k in range(1, 40)]
    texts += ["", " ", "a ", " a", "a  b", "a\u00a0 b \u3000c d\u2003e", "“x” — y", "x\n", "z<|endoftext|> y", "\x1c a"]
    large, small = Encoder(default_path()), Encoder(default_path(), memory=2000)
    plain = [large.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for e in (large, small, large):
        for some in ([x] for x in range(len(texts))), [list(range(len(texts)))]:
            for numbers in some:
                found = e.encode([texts[i] for i in numbers])
                assert [[int.from_bytes(f[j : j + 4], "little") for j in range(0, len(f), 4)] for f in found] == [plain[i] for i in numbers]
    assert small.size <= 2000 < large.size


def test_units_of_one_key_are_told_apart(monkeypatch):
    """Where the first hash says nothing, the second does."""
    e = Encoder(default_path())
    hashed = Encoder._hashed
    monkeypatch.setattr(Encoder, "_hashed", staticmethod(lambda *a: (hashed(*a)[0] % 3, hashed(*a)[1])))
    texts = ["one two three four five one", "six seven  eight one two"]
    for _ in range(2):
        assert [len(x) // 4 for x in e.encode(texts)] == [len(e.tokenizer.encode(t).ids) for t in texts]
        assert e.encode(texts)[0][:4] == e.tokenizer.encode("one").ids[0].to_bytes(4, "little")

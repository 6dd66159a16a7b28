"""Spelling variants: words one edit apart, found by PartEnum signatures.

A word's letters are a multiset, read as a binary vector with one dimension for the i-th occurrence of a letter. One inserted, deleted
or replaced letter changes at most two dimensions. Dimensions are dealt over ``parts`` parts; two vectors that differ in two
dimensions agree on all but two parts, so each word has one signature for every pair of parts left out, and variants
share at least one. Words meet in an equality join on the signature and are verified by their edit distance; equal signatures of
different vectors only cost a comparison. A signature that more than ``most`` words have is refined, not cut off: words one edit
apart share the first or the last half of their letters, so such words meet by signature and half.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, pieces, stored
from mapshelf.llm.words import mix

#: Runs of a-z and of U+00C0 to U+00FF, over UTF-8 in lower case.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One letter of so many runs of documents is left out.
DROPPED = 97
#: Different words that a task counts before it hands them on.
_HELD = 200_000


def words(docs: DataFrame, least: int = 5, often: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of ``least`` letters or more that occur ``often`` times or more.

    A run is a longest one of the letters A-Z, a-z and U+00C0 to U+00FF of a text; A-Z are lower-cased. Where 97 divides the unsigned crc32 of
    ``<id>:<run>``, the letter at that number modulo the run's length is deleted, in all the run's occurrences of the document. A null id is written
    as nothing, a null text has no runs, and repeated rows count as often as they stand there.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for part in (p for b in batches for p in pieces(b, "text")):
            for number, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if number is None else number}:".encode())
                for run, n in Counter(_RUN.findall((text or "").encode().lower())).items():
                    h = zlib.crc32(run, start)
                    if h % DROPPED == 0:
                        letters = run.decode()
                        at = h % len(letters)
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    found[run] += n
            if len(found) > _HELD:
                yield _counted(found)
                found = Counter()
        yield _counted(found)

    def _counted(found: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in ((run.decode(), n) for run, n in found.items()) if len(w) >= least]
        return batch(schema, [w for w, _ in kept], [n for _, n in kept])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _signed(vocabulary: DataFrame, parts: int) -> DataFrame:
    """(signature, word): one row for each pair of parts left out."""
    schema = pa.schema([("signature", pa.int64()), ("word", pa.string())])
    pairs = np.array(list(combinations(range(parts), 2)))
    salt = mix(np.arange(1, len(pairs) + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            some = part.column("word")
            letters = np.frombuffer("".join(some.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
            length = np.char.str_len(np.array(some.to_pylist(), "U"))
            row = np.repeat(np.arange(len(length)), length)
            order = np.lexsort((letters, row))
            new = np.ones(len(order), bool)
            new[1:] = (letters[order][1:] != letters[order][:-1]) | (row[1:] != row[:-1])
            at = np.arange(len(order))
            nth = at - np.maximum.accumulate(np.where(new, at, 0))
            dimension = mix(letters[order] * np.uint64(1 << 20) + nth.astype(np.uint64) + np.uint64(1))
            cell = row * parts + ((dimension >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            by_part = np.zeros(len(length) * parts, np.uint64)
            np.add.at(by_part, cell, mix(dimension))
            by_part = by_part.reshape(-1, parts)
            left = by_part.sum(1, dtype=np.uint64)[:, None] - by_part[:, pairs[:, 0]] - by_part[:, pairs[:, 1]]
            yield batch(schema, mix(left ^ salt).ravel().view(np.int64), some.take(pa.array(np.repeat(np.arange(len(length)), len(pairs)))))

    return vocabulary.select("word").mapInArrow(sign, "signature long, word string")


def near(vocabulary: DataFrame, parts: int = 8, most: int = 64) -> DataFrame:
    """(a, b), a before b: the words that differ by exactly one inserted, deleted or replaced code point. Words are distinct."""
    signed = stored(_signed(vocabulary, parts), "spelling-signatures")
    size = signed.groupBy("signature").agg(F.count("*").alias("size")).where("size > 1")
    met = signed.join(size, "signature").withColumn("length", F.char_length("word"))
    # A word stands for its own length and as the longer of a pair; a half is that of the shorter.
    half = "array(xxhash64(l, 'first', substring(word, 1, l div 2)), xxhash64(l, 'last', right(word, l div 2)))"
    halves = F.expr(f"if(size > {most}, flatten(transform(array(length, length - 1), l -> {half})), array(0L))")
    keyed = stored(met.select("signature", "word", "length", F.explode(halves).alias("half")), "spelling-keys")
    a, b = (keyed.select("signature", "half", F.col("word").alias(x), F.col("length").alias(f"l{x}")) for x in "ab")
    one = F.expr("a < b AND abs(la - lb) <= 1 AND levenshtein(a, b, 1) = 1")
    return a.join(b, ["signature", "half"]).where(one).select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form. The way to the root halves in each round; a form's count is at least twice its word's, so ways are short."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def group(docs: DataFrame, least: int = 5, often: int = 3, times: int = 2, parts: int = 8, most: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the documents and the more frequent spellings they are variants of.

    One row for each of ``words``: ``word``, ``n``, ``n_near`` (words one edit away), ``form`` (the one of these with the largest count, the first in
    the order of code points among equals, if it occurs at least ``times`` as often; else null), ``form_n``, and ``root``: the end of the way over
    forms, the word itself if it has none.

    Whole texts are read. Empty tables, null or empty texts and texts without letters give no words; repeated rows count again. Other columns
    are left out. Nothing is cut off: what the signatures of very many words share is told apart by halves of the words.
    """
    vocabulary = stored(words(docs, least, often, id_col, text_col), "spelling-words")
    links = stored(near(vocabulary, parts, most), "spelling-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("other")), "b")
    best = met.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other")).alias("less"), "b")).alias("best"))
    found = vocabulary.join(best, vocabulary["word"] == best["a"], "left").withColumn("form_n", -F.col("best.less"))
    formed = F.col("form_n") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(formed, F.col("best.b")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    found = stored(found, "spelling-forms")
    roots = _roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

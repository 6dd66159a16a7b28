"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its ``near`` nearest of a fixed number of reference vectors, the pivots. Each pivot has an inverted list of the vectors that
name it. Two vectors are compared if they share at least ``shared`` pivots, and in the list of the smallest pivot they share only, so each
pair is looked at once; the cosine in double precision decides. As that list is never one of a vector's last ``shared`` - 1, it is not put into those.

Pivots lie apart from one another. Among many pivots inside one dense group its members would find their nearest by noise and share few; with few
pivots there, the others are far away and rank alike for all members.

A list is cut into blocks of bounded size, and each pair of its blocks is one group of rows. Inside a group similarities are a
matrix product; what leaves it is a number of links for each vector and a star over each group of linked ones, never the pairs. Equal
vectors are handled once, with their number as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapshelf.llm.common import NULL_ID, batch, numbers, real_id, stored
from mapshelf.llm.graph import components

PIVOTS, NEAR, SHARED, BLOCK = 256, 12, 3, 1500
CANDIDATES, APART = 16, (0.3, 0.4, 0.5, 0.6, 0.7)  # candidates for one pivot; the cosine below which a candidate is apart, let out step by step


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(k, class, vector): unit vectors as bytes of doubles; class and vector null where a vector takes no part."""
    schema = pa.schema([("k", pa.int64()), ("class", pa.binary()), ("vector", pa.binary())])

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names, units = [], []
            for row in part.column("vector"):
                x = np.zeros(0) if row.values is None or row.values.null_count else numbers(row.values).astype(np.float64)
                largest = np.abs(x).max() if len(x) else 0.0
                if not np.isfinite(largest) or not largest or not np.isfinite(x).all():
                    names.append(None)
                    units.append(None)
                    continue
                names.append(blake2b((x + 0.0).tobytes(), digest_size=16).digest())
                x = x / largest  # so that squares neither overflow nor vanish
                units.append((x / np.sqrt(x @ x)).tobytes())
            yield batch(schema, part.column("k"), names, units)

    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(unit, "k long, class binary, vector binary")


def _pivots(classes: DataFrame, count: int, near: int) -> dict[int, np.ndarray]:
    """By length of a vector: the pivots, those that few vectors name first.

    Candidates are the vectors of the smallest hashed classes; only this choice is a sample, of a fixed size. A candidate becomes a pivot if it is
    apart from all chosen before. Vectors that all lie close together have fewer than ``count`` pivots, down to a single one, and so longer lists.
    """
    found: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("class"), "class").limit(CANDIDATES * count).select("vector").collect():
        found.setdefault(len(r["vector"]) // 8, []).append(np.frombuffer(r["vector"]))
    return {n: _spread(np.stack(some), count, near) for n, some in found.items()}


def _spread(candidates: np.ndarray, count: int, near: int) -> np.ndarray:
    chosen: list[int] = []
    closest = np.full(len(candidates), -2.0)
    for apart in APART:
        for i in range(len(candidates)):
            if closest[i] < apart and len(chosen) < count:
                chosen.append(i)
                closest = np.maximum(closest, candidates @ candidates[i])
                closest[i] = 1  # not less by rounding
    pivots = candidates[chosen]
    named = np.bincount(_near(candidates, pivots, near).ravel(), minlength=len(pivots))
    return pivots[np.argsort(named, kind="stable")]


def _near(vectors: np.ndarray, pivots: np.ndarray | None, near: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    if pivots is None:
        return np.zeros((len(vectors), 1), np.int64)
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :near]


def _described(classes: DataFrame, pivots: dict[int, np.ndarray], near: int) -> DataFrame:
    """(class, weight, vector, size, near): each class with its nearest pivots. A length without pivots has one list."""
    schema = pa.schema([("class", pa.binary()), ("weight", pa.int64()), ("vector", pa.binary()), ("size", pa.int32()), ("near", pa.list_(pa.int32()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data = part.column("vector").to_pylist()
            size = np.array([len(x) // 8 for x in data])
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                found = _near(np.frombuffer(b"".join(data[i] for i in rows)).reshape(-1, n), pivots.get(n), near)
                some = part.take(pa.array(rows))
                yield batch(schema, some.column("class"), some.column("weight"), some.column("vector"), np.full(len(rows), n), found.tolist())

    return classes.select("class", "weight", "vector").mapInArrow(describe, "class binary, weight long, vector binary, size int, near array<int>")


def _compare(groups: DataFrame, threshold: float, shared: int, pivots: int) -> DataFrame:
    """(class, links, root) of each class linked in a group, root being the smallest class of those linked there."""
    schema = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pivot, same = table["pivot"][0].as_py(), table["i"][0].as_py() == table["j"][0].as_py()
        names = table["class"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        table = table.take(pa.array(order))
        names = [names[i] for i in order]
        x = np.frombuffer(b"".join(table["vector"].to_pylist())).reshape(len(names), -1)
        weight, left = numbers(table["weight"].combine_chunks()), numbers(table["block"].combine_chunks()) == table["i"][0].as_py()
        member = np.zeros((len(names), pivots), bool)
        near = table["near"].combine_chunks()
        member[np.repeat(np.arange(len(names)), np.diff(numbers(near.offsets))), numbers(near.flatten())] = True
        need, below = min(shared, int(member[0].sum())), np.packbits(np.arange(pivots) < pivot)  # a length without pivots has one list, of which every pair is looked at
        member = np.packbits(member, axis=1)
        a = np.arange(len(names)) if same else np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        root, links = np.arange(len(names)), np.zeros(len(names), np.int64)
        found = []
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            other = b[at:] if same else b
            close = x[some] @ x[other].T >= threshold
            if same:
                close &= some[:, None] < other[None, :]
            p, q = np.nonzero(close)
            p, q = some[p], other[q]
            both = member[p] & member[q]
            mine = (np.bitwise_count(both).sum(1) >= need) & ~(both & below).any(1)
            found.append(np.stack([p[mine], q[mine]]))
        p, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        while True:
            low = np.minimum(root[p], root[q])
            new = root.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        on = np.flatnonzero(links)
        return pa.Table.from_batches([batch(schema, [names[i] for i in on], links[on], [names[root[i]] for i in on])])

    return groups.groupBy("size", "pivot", "i", "j").applyInArrow(compare, "class binary, links long, root binary")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, pivots: int = PIVOTS, near: int = NEAR,
                    shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per vector: the id, ``n_links`` (other vectors at a cosine of ``threshold`` or more), ``component_id`` and ``kept`` (the id is the component's).

    * A null, empty or all-zero vector, or one with a null or non-finite component, is linked with nothing.
    * Vectors of different length are not linked.
    * A null id counts as smaller than all others and stays null. Rows of one id are vectors of their own, linked if near; of those that repeat a
      component's smallest id all are kept.
    * An empty table gives no rows; other columns, labels too, do not matter.

    Every vector is in the index. A pair at the threshold is missed if it shares fewer than ``shared`` of ``near`` pivots; the tests measure the recall.
    """
    rows = stored(_rows(vectors, id_col, vector_col), "vectors")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("k").alias("k"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = stored(classes, "vector-classes")
    known = _pivots(classes, pivots, near)
    described = stored(_described(classes, known, near), "vectors-described")

    listed = F.size("near") - F.least(F.size("near"), F.lit(shared)) + 1
    lists = described.select("*", F.explode(F.slice(F.array_sort("near"), F.lit(1), listed)).alias("pivot"))
    sizes = {(r["size"], r["pivot"]): r["count"] for r in lists.groupBy("size", "pivot").count().where(F.col("count") > block).collect()}  # lists over one block: fewer than pivots and lengths
    blocks = F.lit(1)
    for (size, pivot), n in sizes.items():
        blocks = F.when((F.col("size") == size) & (F.col("pivot") == pivot), F.lit(-(-n // block))).otherwise(blocks)
    lists = lists.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = lists.select("size", "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "weight", "vector", "near")
    found = stored(_compare(groups, threshold, shared, max([1, *(len(p) for p in known.values())])), "vector-links")

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("class"), "root")
    named = classes.select("class", "k", "weight").join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = stored(named, "vector-roots")
    smallest = named.groupBy("root").agg(F.min("k").alias("c"))
    named = named.join(smallest, "root").select("class", "c", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("k", "class").join(named, "class", "left").withColumn("c", F.coalesce("c", "k"))
    return out.select(real_id().alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real_id("c").alias("component_id"), (F.col("k") == F.col("c")).alias("kept"))

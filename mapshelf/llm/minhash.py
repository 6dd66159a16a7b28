"""Near-duplicate documents by bottom-k sketches.

A document's set is its distinct word shingles. Documents with equal sets form a class, which is handled once. A sketch holds the ``k`` smallest
values of one hash function over the set. Inverted lists of the retained values bring classes together; the number
of shared values and the estimate from the smallest ``k`` values of both sketches filter; the full sets decide.

No long list is expanded into all its pairs. A value that more than ``rare`` classes retain is common. A class of which half the sketch is rare is
found through the short lists of rare values, since a partner must share most of those. The others (large groups of near copies) are
compared among themselves through their full sets: values are ordered by how few of these classes have them, and two sets that are similar
enough share one among their first ones, at places that their sizes limit. A copy with more edits than the limit allows has only
values of its own there. In each such list every member is first compared with one, the most typical. What is linked then is one component
already, and only pairs of different components are left to compare. Where a few classes of a list are outside its largest component,
each is paired with all of the list. The other lists with one largest component are a family; classes
outside the component are dealt over blocks of a bounded number of classes, and a task compares one block with all classes of the family, by the
inverted list of the block's values, the estimate from both sketches and the full sets. Only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapshelf.llm.common import batch, key, keyed, pieces, real_id, stored, tidy
from mapshelf.llm.graph import components
from mapshelf.llm.words import Words, ranges, sequence_hash

#: Members compared with one partner in one task; classes outside a list's largest component that are paired with all of the list; classes of
#: a block that all others of its family are compared with.
SHARE, FEW, BLOCK = 256, 8, 256
_FILL = np.uint64(2**64 - 1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of the texts, one after the other, and where each text's begin."""
    words = Words(texts, lower=True)
    n, room = words.counts, words.room()
    whole = sequence_hash(words.hash, size)
    at = np.flatnonzero(room[: len(whole)] >= size)
    owner, value = words.text_of()[at], whole[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, [sequence_hash(words.hash[words.first[t] : words.first[t + 1]], int(n[t]), np.uint64(0xE7037ED1A0B428DB))[0] for t in short]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def _sketched(keys: DataFrame, size: int, k: int) -> DataFrame:
    """(k, v, n, class, sketch) of each document; class null for an empty set."""
    schema = pa.schema([("k", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("sketch", pa.binary())])

    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "text")):
            value, first = shingle_sets(part.column("text"), size)
            data, edges = value.tobytes(), first.tolist()
            sets = [data[8 * a : 8 * z] for a, z in zip(edges, edges[1:])]
            yield batch(schema, part.column("k"), part.column("v"), np.diff(first), [blake2b(s, digest_size=16).digest() if s else None for s in sets], [s[: 8 * k] for s in sets])

    return keys.mapInArrow(sketch, "k long, v long, n long, class binary, sketch binary")


def _lists(classes: DataFrame) -> DataFrame:
    """(value, class, n) for each retained value."""
    schema = pa.schema([("value", pa.int64()), ("class", pa.binary()), ("n", pa.int64())])

    @tidy
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sketches = part.column("sketch").to_pylist()
            row = np.repeat(np.arange(len(sketches)), [len(s) // 8 for s in sketches])
            yield batch(schema, np.frombuffer(b"".join(sketches), np.int64), part.column("class").take(pa.array(row)), part.column("n").take(pa.array(row)))

    return classes.select("class", "n", "sketch").mapInArrow(explode, "value long, class binary, n long")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, floor: float) -> DataFrame:
    """Pairs whose union sketch does not speak against them."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    @tidy
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                union = np.sort(np.concatenate([x, y]))
                twice = union[1:] == union[:-1]
                distinct = union[np.concatenate([[True], ~twice])][:k]
                keep.append(np.count_nonzero(union[1:][twice] <= distinct[-1]) >= floor * len(distinct))
            yield batch(schema, *(part.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")))

    one = classes.select(F.col("class").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("class").alias("b"), F.col("sketch").alias("sb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(estimate, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which the full sets are similar enough. A set that meets many partners is sent once for each SHARE of them."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    own = shares.join(sets, F.col("a") == F.col("class")).select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("binary").alias("b"), "set")
    other = pairs.join(shares, "a").join(sets, F.col("b") == F.col("class")).select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b", "set")

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for part in batches:
            a, b = [], []
            for x, y, s in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("set").to_pylist()):
                s = np.frombuffer(s, np.uint64)
                if y is None:
                    mine = s
                    continue
                both = np.sort(np.concatenate([mine, s]))
                shared = np.count_nonzero(both[1:] == both[:-1])
                if 100 * shared >= percent * (len(both) - shared):
                    a.append(x)
                    b.append(y)
            yield batch(schema, a, b)

    near = own.unionByName(other).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return near.select("a", "b", "set").mapInArrow(compare, "a binary, b binary")


def _fits(percent: int, x: str, y: str) -> str:
    """Whether two sets can be similar enough, sharing their values at places px and py: as many must follow as have to be shared."""
    shared = f"ceil({percent} * ({x} + {y}) / {100 + percent})"
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y}) AND px <= {x} - {shared} AND py <= {y} - {shared}"


def _short_pairs(lists: DataFrame, typical: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of the short lists that share two values, or one where a set has fewer than 20. Two typical classes meet elsewhere."""
    lists = lists.join(typical.select("class", "own"), "class", "left").withColumn("typical", F.col("own").isNotNull())
    x = lists.select("value", F.col("class").alias("a"), F.col("n").alias("na"), F.col("typical").alias("ta"))
    y = lists.select("value", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("typical").alias("tb"))
    pairs = x.join(y, "value").where("a < b AND NOT (ta AND tb)").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.least(F.first("na"), F.first("nb")).alias("n"))
    return found.where(F.col("shared") >= F.when(F.col("n") >= 20, 2).otherwise(1)).select("a", "b")


def _first_values(sets: DataFrame, percent: int) -> DataFrame:
    """(value, class, n, place): the values by which classes of similar sets meet, places from 0 in the order of how few classes have a value."""
    schema = pa.schema([("value", pa.int64()), ("class", pa.binary()), ("n", pa.int64())])

    @tidy
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "set")):
            some = part.column("set").to_pylist()
            n = np.array([len(s) // 8 for s in some], np.int64)
            row = np.repeat(np.arange(len(some)), n)
            yield batch(schema, np.frombuffer(b"".join(some), np.int64), part.column("class").take(pa.array(row)), n[row])

    values = sets.select("class", "set").mapInArrow(explode, "value long, class binary, n long")
    counted = values.groupBy("value").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("df", "value")) - 1
    ordered = values.join(counted, "value").withColumn("place", place)
    return ordered.where(F.expr(f"df > 1 AND place <= n - ceil({percent} * n / 100)")).select("value", "class", "n", "place")


def _star(lists: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a list with the one that has the fewest values of its own."""
    rows = lists.join(own, "class")
    first = rows.groupBy("value").agg(F.min(F.struct("own", "class", "n", "place")).alias("first"))
    first = stored(first.select("value", F.col("first.class").alias("a"), F.col("first.n").alias("na"), F.col("first.place").alias("px")), "lists-first")
    met = rows.select("value", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("place").alias("py")).join(first, "value")
    return met.where("a <> b").where(_fits(percent, "na", "nb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open(lists: DataFrame, label: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists whose classes are in several components: (a, b), the pairs left to compare in those where at most FEW classes are outside the
    list's largest component, and the rows of the others."""
    rows = lists.join(label, "class", "left").withColumn("root", F.coalesce("root", "class"))
    groups = stored(rows.groupBy("value", "root").agg(F.count("*").alias("members")), "lists-groups")
    main = groups.groupBy("value").agg(F.max(F.struct("members", "root")).alias("main"), F.sum("members").alias("members"), F.count("*").alias("groups"))
    main = main.where("groups > 1").select("value", F.col("main.root").alias("main"), (F.col("members") - F.col("main.members")).alias("outside"))
    rows = stored(rows.join(stored(main, "lists-main"), "value").withColumn("out", F.col("root") != F.col("main")), "lists-open")
    few = F.col("outside") <= FEW
    x = rows.where(few & F.col("out")).select("value", F.col("class").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("root").alias("rx"))
    y = rows.where(few).select("value", F.col("class").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("root").alias("ry"), "out")
    pairs = x.join(y, "value").where("rx <> ry AND (NOT out OR x < y)").where(_fits(percent, "nx", "ny"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), rows.where(~few).select("value", "class", "n", "place", "root", "main")


def _families(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, block, out, class, root, n, set, value, place): what ``_linked`` compares.

    The lists with one largest component are a family, so two classes that share a value are together in one. Those outside that
    component (``out``) are dealt over blocks, and all classes of the family meet each block.
    """
    rows = lists.select(F.col("main").alias("family"), "class", "root").distinct().withColumn("out", F.col("root") != F.col("family"))
    rows = stored(rows, "families")
    blocks = F.ceil(F.count_if("out") / BLOCK).cast("int")
    sizes = rows.groupBy("family").agg(blocks.alias("blocks"))
    value = F.sort_array(F.collect_list(F.struct("value", "place")))
    values = lists.groupBy("class").agg(F.first("n").alias("n"), value.alias("met"))
    values = values.select("class", "n", F.col("met.value").alias("value"), F.col("met.place").alias("place"))
    rows = stored(rows.join(sizes, "family").join(values, "class").join(sets, "class"), "families-sets")
    names = ["family", "block", "out", "class", "root", "n", "set", "value", "place"]
    x = rows.where("out").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("side", F.lit(0))
    y = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    dealt = x.select("side", *names).unionByName(y.select("side", *names))
    return dealt.repartition("family", "block").sortWithinPartitions("family", "block", "side")


def _near_estimates(x: np.ndarray, y: np.ndarray, floor: float, k: int) -> np.ndarray:
    """Of rows of sketches (filled up with the largest number), which have unions of which at least ``floor`` is shared."""
    union = np.sort(np.concatenate([x, y], axis=1), axis=1)
    real = union != _FILL
    twice = np.zeros_like(real)
    twice[:, 1:] = (union[:, 1:] == union[:, :-1]) & real[:, 1:]
    within = np.cumsum(real & ~twice, axis=1) <= k
    return (twice & within).sum(1) >= floor * (real & ~twice & within).sum(1)


def _linked(dealt: DataFrame, percent: int, k: int, floor: float) -> DataFrame:
    """(a, b): similar classes of different components. A task holds one block and reads the classes that meet it; only links leave it."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def sketches(sets: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(sets), k), _FILL)
        for row, s in zip(out, sets):
            row[: min(k, len(s))] = s[:k]
        return out

    def opened(rows: list[dict]) -> tuple:
        """Sets, sketches, sizes, classes, roots, and (value, place, row) of the values by which they meet, sorted."""
        sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
        value, place = (np.concatenate([np.array(r[c], np.int64) for r in rows]) for c in ("value", "place"))
        owner = np.repeat(np.arange(len(rows)), [len(r["value"]) for r in rows])
        order = np.argsort(value, kind="stable")
        n = np.array([r["n"] for r in rows], np.int64)
        return sets, sketches(sets), n, [r["class"] for r in rows], [r["root"] for r in rows], value[order], place[order], owner[order]

    def compare(x: tuple, rows: list[dict]) -> pa.RecordBatch:
        y = opened(rows)
        low, high = (np.searchsorted(x[5], y[5], side=side) for side in ("left", "right"))
        mine = ranges(low, high - low)
        i, px = x[7][mine], x[6][mine]
        j, py = (np.repeat(c, high - low) for c in (y[7], y[6]))
        nx, ny = x[2][i], y[2][j]
        shared = -(-percent * (nx + ny) // (100 + percent))
        fits = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (px <= nx - shared) & (py <= ny - shared)
        pairs = np.unique(i[fits] * len(rows) + j[fits])
        i, j = pairs // len(rows), pairs % len(rows)
        # Two classes that are both outside meet in either order; the first of them reports it.
        apart = np.array([x[4][p] != y[4][q] and not (rows[q]["out"] and x[3][p] > y[3][q]) for p, q in zip(i.tolist(), j.tolist())], bool)
        i, j = i[apart], j[apart]
        near = np.concatenate([np.zeros(0, bool), *(_near_estimates(x[1][i[at : at + 4096]], y[1][j[at : at + 4096]], floor, k) for at in range(0, len(i), 4096))])
        found = []
        for p, q in zip(i[near].tolist(), j[near].tolist()):
            both = np.sort(np.concatenate([x[0][p], y[0][q]]))
            same = np.count_nonzero(both[1:] == both[:-1])
            if 100 * same >= percent * (len(both) - same):
                found.append(sorted((x[3][p], y[3][q])))
        return batch(schema, [a for a, _ in found], [b for _, b in found])

    @tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, x = None, [], None
        for part in (p for b in batches for p in pieces(b, "set")):
            other: list[dict] = []
            for row in part.to_pylist():
                if (row["family"], row["block"]) != here:
                    if other:
                        yield compare(x, other)
                    here, held, x, other = (row["family"], row["block"]), [], None, []
                if row["side"] == 0:
                    held.append(row)
                    continue
                if held:
                    x = x or opened(held)
                    other.append(row)
            if other:
                yield compare(x, other)

    return dealt.mapInArrow(blocks, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, k: int = 64, rare: int = 8, floor: float = 0.5) -> DataFrame:
    """Group documents that are linked by a Jaccard similarity of ``percent`` / 100 or more, directly or over others.

    Words are runs of anything but space and 0x09 to 0x0D, with A-Z lower-cased. A set is the distinct ``size``-word shingles; with fewer
    words, all of them as one shingle. One row per row of ``docs``: the id, ``n_shingles``, ``class_id`` (documents with equal sets; null
    for an empty set), ``component_id`` (smallest id reachable, itself included) and ``kept`` (the id is the component's).

    * A null or empty text, or one without words, has an empty set and is linked with nothing.
    * A null id counts as smaller than all others and stays null, also as a component's id; its row is kept.
    * Repeated rows are linked like other copies; rows that repeat the smallest id of a component are all kept.
    * Texts are read whole, tables may be empty, and other columns are left out.

    At k = 64 a partner at the limit is missed through the lists or the estimate (``floor``) with a chance below 1e-7.
    """
    out = _grouped(docs, id_col, text_col, size, percent, k, rare, floor)
    return out.select(real_id().alias(id_col), F.col("n").alias("n_shingles"), F.hex("class").alias("class_id"), real_id("c").alias("component_id"), (F.col("k") == F.col("c")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, k: int = 64, rare: int = 8, floor: float = 0.5) -> DataFrame:
    """The documents with all their columns, of each group the one of the smallest id only. Rows that repeat an id and text stay or go together."""
    gone = _grouped(docs, id_col, text_col, size, percent, k, rare, floor).where("k <> c").select("k", "v").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key(id_col, text_col))
    return rows.join(gone, ["k", "v"], "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, k: int, rare: int, floor: float) -> DataFrame:
    """(k, v, n, class, c) of each row, c being its component's smallest id."""
    keys = keyed(docs, id_col, text_col)
    rows = stored(_sketched(keys, size, k), "sketches")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("k", "v")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")

    counted = stored(_lists(classes).groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "values")
    lists = stored(_lists(classes).join(counted, "value").select("value", "class", "n", (F.col("df") > rare).alias("common")), "lists")
    common = lists.where("common").groupBy("class").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    retained = F.least("n", F.lit(k))
    typical = stored(common.where(2 * F.col("shared") > retained).select("class", (retained - F.col("shared")).alias("own")), "classes-typical")

    def sets_of(some: DataFrame) -> DataFrame:
        named = some.join(classes.select("class", "rep.k", "rep.v"), "class").select("class", "k", "v")
        return stored(_sets(keys.join(named, ["k", "v"]).select("class", "text"), size).dropDuplicates(["class"]), "sets")

    sets = sets_of(typical.select("class"))
    meet = stored(_first_values(sets, percent), "lists-typical")
    pairs = _short_pairs(lists.where("NOT common"), typical, percent).unionByName(_star(meet, typical, percent)).distinct()
    pairs = stored(_estimated(pairs, classes, k, floor), "pairs")
    others = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(typical, "class", "left_anti")
    links = stored(_verified(pairs, sets.unionByName(sets_of(others)), percent), "links-star")
    label = stored(components(links).select(F.col("node").alias("class"), "root"), "labels")
    pairs, many = _open(meet, label, percent)
    more = stored(_estimated(pairs, classes, k, floor), "pairs-open")
    links = links.unionByName(stored(_verified(more, sets, percent), "links-open"))
    links = links.unionByName(stored(_linked(_families(many, sets), percent, k, floor), "links-families"))

    roots = components(links).select(F.col("node").alias("class"), "root")
    by_class = stored(classes.select("class", "rep.k").join(roots, "class", "left").select("class", "k", F.coalesce("root", "class").alias("root")), "class-roots")
    smallest = by_class.groupBy("root").agg(F.min("k").alias("c"))
    named = by_class.join(smallest, "root").select("class", "c")
    return rows.join(named, "class", "left").select("k", "v", "n", "class", F.coalesce("c", "k").alias("c"))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("class", pa.binary()), ("set", pa.binary())])

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, "text")):
            value, first = shingle_sets(part.column("text"), size)
            data, edges = value.tobytes(), first.tolist()
            yield batch(schema, part.column("class"), [data[8 * a : 8 * z] for a, z in zip(edges, edges[1:])])

    return texts.mapInArrow(whole, "class binary, set binary")

"""Mixing sources to target weights, block by block.

The words of each source stand in one long row, document after document, cut into blocks of a fixed number of words. The
output is a row of slots, dealt over shards. Each shard draws how many of its slots each source gets: a multinomial draw
given the sources' totals, so the totals come out exactly. The slots of a source are numbered over all shards; a pseudorandom
permutation of the block numbers (a Feistel network, new for each pass over the source) gives the block of a slot, and slots
meet blocks in a join on the block number. Another permutation puts the slots of a shard in order. The mix is these rows of (shard, slot); what
it takes of each document, and the documents' texts, are counted from them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapshelf.llm.common import NULL_ID, WORD, batch, key, real_id, stored
from mapshelf.llm.words import mix as scramble

#: Rows that one running sum covers, and the most such groups a source is cut into.
GROUP_ROWS, MOST_GROUPS = 64, 1 << 16
#: Sources are known by number on the driver; more than these are refused.
MOST_SOURCES = 100_000
#: Numbers drawn: shards times sources; shards grow with the output beyond.
MOST_DRAWS = 2_000_000


@dataclass(frozen=True)
class Mix:
    """Weights, given to the sources in the order of their code points, null last, and repeated; ``share`` of all words is taken, no source
    over ``most`` times."""

    weights: Sequence[float] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block: int = 64
    shard: int = 1 << 14
    seed: int = 17


def targets(sizes: Sequence[int], mix: Mix) -> list[float]:
    """Words to take of each source; what is above ``most`` times its size goes to the others by their weights."""
    weight = [float(mix.weights[i % len(mix.weights)]) for i in range(len(sizes))]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), mix.share * sum(sizes)
    while free:
        unit = sum(weight[i] for i in free)
        over = [i for i in free if rest * weight[i] / unit > mix.most * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weight[i] / unit
            break
        for i in over:
            out[i] = float(mix.most * sizes[i])
        free -= set(over)
        rest = mix.share * sum(sizes) - sum(out)
    return out


def draw(slots: Sequence[int], mix: Mix) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): each shard's draw from the slots the sources have left."""
    left, given = np.array(slots, np.int64), np.zeros(len(slots), np.int64)
    rng = np.random.default_rng(mix.seed)
    size, shard = max(mix.shard, int(left.sum()) * len(slots) // MOST_DRAWS), 0
    while left.sum():
        todo, n = min(size, int(left.sum())), np.zeros(len(slots), np.int64)
        while todo:
            rest = left - n
            n += np.minimum(rng.multinomial(todo, rest / rest.sum()), rest)
            todo = min(size, int(left.sum())) - int(n.sum())
        yield from ((shard, int(s), int(given[s]), int(n[s])) for s in np.flatnonzero(n))
        left, given, shard = left - n, given + n, shard + 1


def permuted(index: np.ndarray, n: int, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 that belongs to the key takes each index."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, k = out[todo], key[todo]
        left, right = x >> shift, x & low
        for r in range(rounds):
            left, right = right, left ^ (scramble(right ^ scramble(k + np.uint64(r + 1))) & low)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]  # outside the range: go on along the cycle
    return out.astype(np.int64)


def _laid_out(docs: DataFrame, source_col: str, id_col: str, text_col: str) -> DataFrame:
    """(k, v, source, size, grp) with grp a part of the source of bounded size."""
    text = F.col(text_col).cast("string")
    sizes = stored(docs.select(F.col(source_col).cast("string").alias("source"), *key(id_col, text_col),
                               F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    groups = min(MOST_GROUPS, max(1, 1 << (sizes.count() // GROUP_ROWS).bit_length()))
    return sizes.withColumn("grp", F.pmod(F.xxhash64("k", "v"), F.lit(groups)))


def plan(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document.

    Columns: the id, ``k`` and ``v`` (its key), ``nth`` among repeated rows, ``source``, ``size`` in words, ``source_size``,
    ``target`` of the source, ``taken`` words with repeats counted, and ``runs``: (start, stop, times) of its words, taken at least once.

    One row per row of ``docs``. A null or empty text has size 0 and nothing taken; a null source is a source of its own, after the others. Rows that
    repeat an id and text are separate documents with a place each. Rerunning gives the same mix. An empty table gives an
    empty plan. Blocks are ``mix.block`` words, so a source is taken to within half a block of its target, the last block's shortness aside.
    Other columns are left out.
    """
    placed, dealt = _dealt(docs, mix, id_col, text_col, source_col)
    each = dealt.select("number", F.explode("runs").alias("run")).groupBy("number", "run.k", "run.v", "run.nth", "run.start", "run.stop").agg(F.count(F.lit(1)).cast("int").alias("times"))
    runs = each.groupBy("number", "k", "v", "nth").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "times"))).alias("runs"), F.sum(F.expr("(stop - start) * times")).alias("taken"))
    out = placed.join(runs, ["number", "k", "v", "nth"], "left")
    return out.select(real_id().alias(id_col), "k", "v", "nth", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "runs")


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: one row for each slot of the output, in the order of ``shard`` and ``slot``.

    Columns: ``shard``, ``slot`` (from 0 in each shard), ``source``, ``block`` of the source, and ``runs``: the words of the block in their order, as (the
    id, ``k``, ``v``, ``nth``, start, stop) with the names and numbers of ``plan``.
    """
    placed, dealt = _dealt(docs, mix, id_col, text_col, source_col)
    names = placed.select("number", "source").distinct()
    run = lambda r: F.struct(F.when(r["k"] != NULL_ID, r["k"]).alias(id_col), *(r[x].alias(x) for x in ("k", "v", "nth", "start", "stop")))
    return dealt.join(names, "number").select("shard", "slot", "source", "block", F.transform("runs", run).alias("runs"))


def _dealt(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their places in their sources, and (shard, slot, number, block, runs) of the mix."""
    spark = docs.sparkSession
    rows = _laid_out(docs, source_col, id_col, text_col)
    by_group = rows.groupBy("source", "grp").agg(F.sum("size").alias("words"))
    totals = by_group.groupBy("source").agg(F.sum("words").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = sorted(((r["source"], r["words"]) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    wanted = targets([n for _, n in sources], mix)
    blocks = [-(-n // mix.block) for _, n in sources]
    slots = [min(mix.most * b, round(t * b / n)) if n else 0 for (_, n), b, t in zip(sources, blocks, wanted)]
    known = spark.createDataFrame([(i, s, n, t) for i, ((s, n), t) in enumerate(zip(sources, wanted))],
                                  "number int, source string, source_size long, target double")

    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = by_group.select("source", "grp", before.alias("base"))
    order = Window.partitionBy("source", "grp").orderBy("k", "v")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    nth = F.row_number().over(Window.partitionBy("source", "grp", "k", "v").orderBy("inside"))
    null_safe = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    placed = rows.withColumn("inside", inside).withColumn("nth", nth).alias("r")
    placed = placed.join(base.alias("b"), null_safe("r", "b") & (F.col("r.grp") == F.col("b.grp")))
    placed = placed.join(F.broadcast(known).alias("s"), null_safe("r", "s"))
    placed = stored(placed.select("number", "r.source", "k", "v", "nth", "size", "source_size", "target", (F.col("base") + F.col("inside")).alias("start")), "mix-placed")

    stop = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / mix.block), F.floor((stop - 1) / mix.block)
    cut = placed.where("size > 0").select("number", "k", "v", "nth", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    a = F.greatest(F.lit(0), F.col("block") * mix.block - F.col("start")).cast("long")
    z = F.least(F.col("size"), (F.col("block") + 1) * mix.block - F.col("start")).cast("long")
    run = F.struct(F.col("start").alias("place"), "k", "v", "nth", a.alias("start"), z.alias("stop"))
    filled = cut.groupBy("number", "block").agg(F.sort_array(F.collect_list(run)).alias("runs"))  # no more runs than words of a block
    # Spark takes the slots for as few bytes as the draws they are made from, and would broadcast them at any size.
    return placed, _slots(spark, list(draw(slots, mix)), blocks, mix).hint("merge").join(filled, ["number", "block"])


def _slots(spark: SparkSession, shards: list[tuple[int, int, int, int]], blocks: list[int], mix: Mix) -> DataFrame:
    """(shard, slot, number, block): one row for each slot of the output."""
    seed, length = mix.seed, np.array(blocks, np.int64)
    total: dict[int, int] = {}
    placed = []
    for shard, source, first, n in shards:  # before a source come the shard's slots of the sources before it
        placed.append((shard, source, first, n, total.get(shard, 0)))
        total[shard] = total.get(shard, 0) + n
    placed = [(*row, total[row[0]]) for row in placed]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("number", pa.int32()), ("block", pa.int64())])
        for part in batches:
            for shard, source, first, n, before, size in zip(*(c.to_pylist() for c in part.columns)):
                for at in range(first, first + n, 1 << 20):
                    slot = np.arange(at, min(at + (1 << 20), first + n))
                    turn = (slot // length[source]).astype(np.uint64)
                    key = scramble(turn * np.uint64(0x9E3779B97F4A7C15) + np.uint64(source * 2**32 + seed))
                    order = np.full(len(slot), scramble(np.array([shard * 2**32 + seed], np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))[0])
                    inside = permuted(slot - first + before, size, order)
                    yield batch(schema, np.full(len(slot), shard), inside, np.full(len(slot), source), permuted(slot % length[source], int(length[source]), key))

    rows = spark.createDataFrame(placed, "shard int, number int, first long, n long, before long, size long")
    # A given number of partitions, as Spark would merge these few bytes into one task that makes all slots.
    return rows.repartition(len(total) or 1, "shard", "number").mapInArrow(fill, "shard int, slot long, number int, block long")


def mixed_texts(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``.

    A document gives one row for each time that words of it are taken: the words taken at least once, then those taken at
    least twice, and so on, joined by one space; a text taken whole is left as it is. What is not taken at all gives no row.
    """
    chosen = plan(docs, mix, id_col, text_col, source_col).where("taken > 0").select("k", "v", "nth", "source", "size", "runs").alias("c")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key(id_col, text_col), F.col(source_col).cast("string").alias("source"))
    same = Window.partitionBy("k", "v").orderBy("source")
    rows = rows.withColumn("nth", F.row_number().over(same) - F.rank().over(same) + 1).alias("d")
    on = [F.col(f"d.{c}") == F.col(f"c.{c}") for c in ("k", "v", "nth")]
    out = rows.join(chosen, [*on, F.col("d.source").eqNullSafe(F.col("c.source"))]).select("row", "size", "runs")
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("runs", lambda r: r["times"])))))
    out = out.withColumn("runs", F.filter("runs", lambda r: r["times"] >= F.col("time")))
    text = F.col("row")[text_col].cast("string")
    whole = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r["stop"] - r["start"]) == F.col("size")
    out = out.withColumn("words", F.when(~whole, F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)))
    some = F.flatten(F.transform("runs", lambda r: F.slice("words", r["start"].cast("int") + 1, (r["stop"] - r["start"]).cast("int"))))
    text = F.when(F.col("words").isNull(), text).otherwise(F.array_join(some, " "))
    return out.select(F.col("row").withField(text_col, text).alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])

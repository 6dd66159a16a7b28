"""Spatial partitioning: every feature gets a ``part_id`` by the centre of its box.

All methods look at the data through something whose size follows the number of partitions, a
histogram or a sample, and assign every row by its own coordinates. No row is moved to decide where it goes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions.grid import interleave
from mapshelf.operators.summary import feature_bytes
from mapshelf.session import materialize

# Bits of a histogram side: at least so many, and so many more than the partitions along it need.
LEAST_BITS, SPARE_BITS = 10, 5
# Rows sampled for each leaf of a split tree, and at least; leaves that are cut from one sample on the driver.
PER_LEAF, FEWEST, COARSE = 100, 10_000, 1024
# Places at which a node may be cut along each axis.
CUTS = 9
TARGET_BYTES = 128 << 20

Extent = tuple[float, float, float, float]
WORLD: Extent = (-180.0, -90.0, 180.0, 90.0)


CENTRE = ("((xmin + xmax) / 2)", "((ymin + ymax) / 2)")


def _bin(v: str, low: float, high: float, bins: int) -> str:
    span = high - low if high > low else 1.0
    return (f"coalesce(int(greatest(0, least({bins - 1}, "
            f"floor(({v} - {G.num(low)}) / {G.num(span)} * {G.num(bins)})))), 0)")


def extent_of(df: DataFrame) -> Extent:
    row = G.with_mbr(df).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    return tuple(row) if row[0] is not None else WORLD


def _slot(window: W, weight: str, n: int) -> Column:
    """Which of ``n`` equal shares of the total weight a histogram row starts in."""
    before = F.coalesce(F.sum(weight).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(weight).over(window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return F.floor(before * n / total).cast("int")


def grid_partition(df: DataFrame, parts: int = 64, extent: Extent | None = None, **_) -> DataFrame:
    """Equal cells: ``ceil(sqrt(parts))`` columns and rows."""
    f, side = G.with_mbr(df), math.ceil(math.sqrt(parts))
    x0, y0, x1, y1 = extent or extent_of(f)
    cx, cy = CENTRE
    part = f"{_bin(cy, y0, y1, side)} * {side} + {_bin(cx, x0, x1, side)}"
    return f.withColumn("part_id", F.expr(part))


def histogram_bits(parts: int) -> int:
    return max(LEAST_BITS, math.ceil(math.log2(max(parts, 1)) / 2) + SPARE_BITS)


def _binned(df: DataFrame, extent: Extent | None, bits: int) -> DataFrame:
    f = G.with_mbr(df)
    x0, y0, x1, y1 = extent or extent_of(f)
    cx, cy = CENTRE
    return f.withColumns({"_bx": F.expr(_bin(cx, x0, x1, 1 << bits)), "_by": F.expr(_bin(cy, y0, y1, 1 << bits))})


def str_partition(df: DataFrame, parts: int = 64, extent: Extent | None = None,
                  weight: str | None = None, **_) -> DataFrame:
    """Sort-tile: slabs of equal weight by x, then tiles of equal weight by y in each slab."""
    side = math.ceil(math.sqrt(parts))
    binned = _binned(df, extent, histogram_bits(parts))
    w = F.expr(weight or "1")
    cells = materialize(binned.groupBy("_bx", "_by").agg(F.sum(w).alias("w")), "histogram")
    # The running total over all columns has one row per bin of the x axis.
    slabs = cells.groupBy("_bx").agg(F.sum("w").alias("w"))
    slabs = slabs.select("_bx", _slot(W.orderBy("_bx"), "w", side).alias("slab"))
    tiles = cells.join(slabs, "_bx").groupBy("slab", "_by").agg(F.sum("w").alias("w"))
    tiles = tiles.select("slab", "_by", _slot(W.partitionBy("slab").orderBy("_by"), "w", side).alias("tile"))
    lookup = cells.select("_bx", "_by").join(slabs, "_bx").join(tiles, ["slab", "_by"]).select(
        "_bx", "_by", (F.col("slab") * side + F.col("tile")).alias("part_id"))
    return _assign(binned, lookup)


def zcurve_partition(df: DataFrame, parts: int = 64, extent: Extent | None = None,
                     weight: str | None = None, **_) -> DataFrame:
    """Runs of equal weight along the Z-order curve."""
    low = histogram_bits(parts)
    binned = _binned(df, extent, low)
    w = F.expr(weight or "1")
    cells = materialize(binned.groupBy("_bx", "_by").agg(F.sum(w).alias("w")), "histogram")
    # Coarse runs of the curve first, so the running total inside them is spread over tasks.
    keyed = cells.withColumn("z", F.expr(interleave("_bx", "_by", low))).withColumn(
        "run", F.shiftright("z", low))
    # As many runs at most as a side has bins, of as many cells each.
    runs = keyed.groupBy("run").agg(F.sum("w").alias("rw"))
    runs = runs.select("run", (F.sum("rw").over(W.orderBy("run")) - F.col("rw")).alias("start"),
                       F.sum("rw").over(W.partitionBy()).alias("total"))
    inner = F.sum("w").over(W.partitionBy("run").orderBy("z")) - F.col("w")
    lookup = keyed.join(runs, "run").select(
        "_bx", "_by", F.floor((F.col("start") + inner) * parts / F.col("total")).cast("int").alias("part_id"))
    return _assign(binned, lookup)


def _assign(binned: DataFrame, lookup: DataFrame) -> DataFrame:
    """Join by histogram cell. The lookup has a row of three numbers for each occupied cell;
    the optimizer broadcasts it when its actual size allows."""
    return binned.join(lookup, ["_bx", "_by"]).drop("_bx", "_by")


# ---------------------------------------------------------------- balanced split tree

@dataclass
class SplitTree:
    """Arrays of a binary split of the plane; leaves are partitions."""
    axis: np.ndarray       # 0 or 1; -1 at leaves
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaf: np.ndarray       # partition number at leaves

    def locate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            axis = self.axis[at]
            live = axis >= 0
            if not live.any():
                return self.leaf[at]
            less = np.where(axis == 0, x, y) < self.value[at]
            at = np.where(live, np.where(less, self.low[at], self.high[at]), at)


def _best_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, shares: int, cuts: int = CUTS) -> tuple[int, float] | None:
    """Axis and value of the cut with the smallest sum of margins among the cuts that leave
    whole multiples of the target share, at least 30 % of them, on both sides; ``cuts`` of them are tried, evenly spread."""
    best = None
    counts = range(max(1, math.ceil(0.3 * shares)), min(shares - 1, math.floor(0.7 * shares)) + 1)
    counts = list(counts) or [shares // 2]
    if len(counts) > cuts:
        counts = [counts[i] for i in np.linspace(0, len(counts) - 1, cuts).astype(int)]
    for axis, (a, b) in enumerate(((x, y), (y, x))):
        order = np.argsort(a, kind="stable")
        sa, sb, cum = a[order], b[order], np.cumsum(w[order])
        lo, hi = np.minimum.accumulate(sb), np.maximum.accumulate(sb)
        rlo, rhi = np.minimum.accumulate(sb[::-1])[::-1], np.maximum.accumulate(sb[::-1])[::-1]
        for c in counts:
            i = int(np.searchsorted(cum, cum[-1] * c / shares))
            i = min(max(i, 1), len(sa) - 1)
            i = int(np.searchsorted(sa, sa[i], side="left"))   # equal values stay together
            if i == 0:
                i = int(np.searchsorted(sa, sa[0], side="right"))
            if i == 0 or i >= len(sa):
                continue
            margin = (sa[i - 1] - sa[0]) + (hi[i - 1] - lo[i - 1]) + (sa[-1] - sa[i]) + (rhi[i] - rlo[i])
            if best is None or margin < best[0]:
                best = (margin, axis, float(sa[i]))
    return None if best is None else best[1:]


def build_split_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, parts: int) -> SplitTree:
    """Top-down split of weighted sample points into about ``parts`` leaves of equal weight."""
    nodes: list[list] = [[-1, 0.0, 0, 0, 0]]
    todo = [(0, np.arange(len(x)), parts)]
    leaves = 0
    while todo:
        node, idx, shares = todo.pop()
        cut = _best_cut(x[idx], y[idx], w[idx], shares) if shares > 1 and len(idx) > 1 else None
        if cut is None:
            nodes[node][4] = leaves
            leaves += 1
            continue
        axis, value = cut
        less = (x if axis == 0 else y)[idx] < value
        left_share = w[idx][less].sum() / max(w[idx].sum(), 1e-300)
        left_parts = min(max(round(shares * left_share), 1), shares - 1)
        nodes[node][:4] = [axis, value, len(nodes), len(nodes) + 1]
        nodes += [[-1, 0.0, 0, 0, 0], [-1, 0.0, 0, 0, 0]]
        todo += [(nodes[node][3], idx[~less], shares - left_parts), (nodes[node][2], idx[less], left_parts)]
    columns = list(zip(*nodes))
    return SplitTree(*[np.array(c) for c in columns])


_NODES = "leaf int, node int, axis int, value double, low int, high int, part int"


def _refined(slim: DataFrame, tree: SplitTree, parts: int, rows: int, total: float, seed: int) -> SplitTree:
    """Cut the leaves of a coarse tree again, each in a task of its own, so that about ``parts`` leaves come out.

    What comes back is the tree itself, two nodes for each partition.
    """
    share = min(1.0, parts * PER_LEAF / rows)

    @F.pandas_udf("int")
    def coarse(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(tree.locate(x.to_numpy(), y.to_numpy()), dtype="int32")

    def cut(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["x", "y", "w"])
        wanted = max(1, round(parts * some.w.sum() / max(total * share, 1e-300)))
        fine = build_split_tree(some.x.to_numpy(), some.y.to_numpy(), some.w.to_numpy(), wanted)
        return pd.DataFrame({"leaf": some.leaf.iloc[0], "node": np.arange(len(fine.axis)), "axis": fine.axis, "value": fine.value,
                             "low": fine.low, "high": fine.high, "part": fine.leaf})

    sample = slim.sample(share, seed=seed + 1).withColumn("leaf", coarse("x", "y"))
    nodes = sample.groupBy("leaf").applyInPandas(cut, _NODES).toPandas().sort_values(["leaf", "node"])
    axis, value, low, high, leaf = ([a] for a in (tree.axis, tree.value, tree.low, tree.high, tree.leaf))
    found = {k: g for k, g in nodes.groupby("leaf")}
    size, number = len(tree.axis), 0
    for at in np.flatnonzero(tree.axis < 0):
        fine = found.get(tree.leaf[at])
        if fine is None:
            tree.leaf[at], number = number, number + 1
            continue
        part = fine.part.to_numpy() + number
        # The coarse leaf becomes the root of its fine tree.
        tree.axis[at], tree.value[at], tree.leaf[at] = fine.axis.iloc[0], fine.value.iloc[0], part[0]
        tree.low[at], tree.high[at] = size + fine.low.iloc[0], size + fine.high.iloc[0]
        axis.append(fine.axis.to_numpy())
        value.append(fine.value.to_numpy())
        low.append(fine.low.to_numpy() + size)
        high.append(fine.high.to_numpy() + size)
        leaf.append(part)
        size, number = size + len(fine), number + int((fine.axis < 0).sum())
    return SplitTree(*(np.concatenate(c) for c in (axis, value, low, high, leaf)))


def rsgrove_partition(df: DataFrame, parts: int | None = None, target_size: int = TARGET_BYTES,
                      balanced: bool = True, weight: str | None = None, seed: int = 7, **_) -> DataFrame:
    """Split tree over a sample of box centres, balanced by bytes.

    Rows and bytes are counted in one pass, and the sample has a size that follows the number of partitions. More than
    ``COARSE`` of them are cut in two levels: a coarse tree on the driver, finer ones on the executors. Partitions stay
    balanced to the sampling error except where many features share one centre, which no cut can part; the writer
    spreads such partitions over several tasks.
    """
    f = G.with_mbr(df)
    w = (weight or feature_bytes(f)) if balanced else "1"
    cx, cy = CENTRE
    slim = f.where("xmin is not null").selectExpr(f"{cx} AS x", f"{cy} AS y", f"double({w}) AS w")
    rows, total = slim.agg(F.count("*"), F.sum("w")).first()
    if parts is None:
        parts = math.ceil((total or 0) / target_size)
    if parts <= 1 or not rows:
        return f.withColumn("part_id", F.lit(0))
    top = parts if parts <= COARSE else math.ceil(math.sqrt(parts))
    sample = slim.sample(min(1.0, max(top * PER_LEAF, FEWEST) / rows), seed=seed).toPandas().sort_values(["x", "y", "w"])
    tree = build_split_tree(sample.x.to_numpy(), sample.y.to_numpy(), sample.w.to_numpy(), top)
    if top < parts:
        tree = _refined(slim, tree, parts, rows, total, seed)

    @F.pandas_udf("int")
    def locate(x: pd.Series, y: pd.Series) -> pd.Series:
        found = tree.locate(x.to_numpy(dtype=float, na_value=0.0), y.to_numpy(dtype=float, na_value=0.0))
        return pd.Series(found, dtype="int32")

    return f.withColumn("part_id", locate(F.expr(cx), F.expr(cy)))


PARTITIONERS: dict[str, Callable[..., DataFrame]] = {
    "rsgrove": rsgrove_partition,
    "grid": grid_partition,
    "str": str_partition,
    "zcurve": zcurve_partition,
}


def spatial_partition(df: DataFrame, method: str = "rsgrove", **options) -> DataFrame:
    """Add ``part_id`` by the named method."""
    if method not in PARTITIONERS:
        raise ValueError(f"Unrecognized partitioner {method}")
    return PARTITIONERS[method](df, **options)

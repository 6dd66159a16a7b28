"""Properties that hold for any input, over many random rows at once."""

import numpy as np
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions.grid import interleave, world_column, world_row
from mapshelf.operators import breaking as K
from mapshelf.operators import partitioning as P


def test_chunks_join_to_the_line(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [(float(a), float(b)) for a, b in rng.integers(0, 99, (int(n), 2))]) for i, n in enumerate(rng.integers(2, 60, 80))]
    df = spark.createDataFrame(rows, "fid int, v array<struct<x:double,y:double>>").selectExpr("fid", "v", f"{G.line('v')} AS geom")
    for t in (5, 6, 17):
        b = K.break_geometries(df, t, position="n").selectExpr("fid", "v", "n", f"{G.vertices_of('geom')} AS part")
        for r in b.groupBy("fid", "v").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("ps")).collect():
            line = []
            for p in r.ps:
                assert 2 <= len(p.part) <= t
                assert not line or line[-1] == p.part[0]
                line += p.part if not line else p.part[1:]
            assert line == r.v


def test_z_order_key_is_one_to_one(spark):
    cells = spark.range(1 << 12).selectExpr("id % 64 AS c", "id div 64 AS r")
    keys = cells.selectExpr(f"{interleave('c', 'r', 6)} AS z")
    assert keys.distinct().count() == 1 << 12
    assert keys.agg(F.min("z"), F.max("z")).first() == (0, (1 << 12) - 1)
    corner = spark.range(1).selectExpr(f"{interleave('(1 << 24) - 1', '0', 24)} AS a", f"{interleave('0', '(1 << 24) - 1', 24)} AS b").first()
    assert corner.b == 2 * corner.a and corner.a | corner.b == (1 << 48) - 1


def test_grid_clamps(spark):
    rows = spark.createDataFrame([(-999.0, -999.0), (-180.0, -90.0), (0.0, 0.0), (180.0, 90.0), (999.0, 999.0)], "x double, y double")
    got = [tuple(r) for r in rows.selectExpr(f"{world_column('x', 3)}", f"{world_row('y', 3)}").collect()]
    assert got == [(0, 0), (0, 0), (4, 4), (7, 7), (7, 7)]


def test_split_tree_is_a_partition_of_the_plane():
    rng = np.random.default_rng(4)
    for n, parts in ((1, 4), (50, 8), (4000, 64)):
        x, y, w = rng.normal(0, 1, n), rng.normal(0, 1, n), rng.uniform(1, 2, n)
        tree = P.build_split_tree(x, y, w, parts)
        leaves = tree.leaf[tree.axis < 0]
        assert sorted(leaves) == list(range(len(leaves))) and len(leaves) <= parts
        found = tree.locate(rng.uniform(-50, 50, 1000), rng.uniform(-50, 50, 1000))
        assert set(found) <= set(leaves)
        if n > 1000:
            load = np.bincount(tree.locate(x, y), weights=w)
            assert load.max() < 1.5 * load.mean()

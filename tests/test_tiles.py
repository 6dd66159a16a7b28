"""Tiles of shapes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions import textgeom as X
from mapshelf.operators import tiles as V

LEVELS = 9


def mercator(x, y):
    phi = np.radians(np.clip(y, -85.0511287798066, 85.0511287798066))
    return (x + 180) / 360, (1 - np.log(np.tan(phi) + 1 / np.cos(phi)) / np.pi) / 2


def meets(u, v, z):
    """Tiles of a level that a path through these places enters, by cutting it at all tile borders."""
    n, found = 1 << z, set()
    for a, b, c, d in zip(u[:-1] * n, v[:-1] * n, u[1:] * n, v[1:] * n):
        t = [0.0, 1.0]
        for p, q in ((a, c), (b, d)):
            if p != q:
                t += [(k - p) / (q - p) for k in range(int(np.floor(min(p, q))), int(np.ceil(max(p, q))) + 1)]
        t = np.unique(np.clip(t, 0, 1))
        m = (t[1:] + t[:-1]) / 2
        for x, y in zip(np.append(a + m * (c - a), [a, c]), np.append(b + m * (d - b), [b, d])):
            found.add((min(n - 1, max(0, int(np.floor(x)))), min(n - 1, max(0, int(np.floor(y))))))
    return found


def holds(rings, x, y):
    odd = False
    for u, v in rings:
        for a, b, c, d in zip(u[:-1], v[:-1], u[1:], v[1:]):
            if (b <= y < d) or (d <= y < b):
                odd ^= a + (y - b) * (c - a) / (d - b) > x
    return odd


def brute(rings, area, levels=LEVELS):
    """{(z, x, y): inside}"""
    rings = [mercator(*np.array(r, float).T) for r in rings]
    out = {}
    for z in range(levels):
        outline = set().union(*(meets(u, v, z) for u, v in rings))
        out |= {(z, *t): False for t in outline}
        if area and z:
            for x, y in {(2 * px + i, 2 * py + j) for pz, px, py in [k for k, v in out.items() if k[0] == z - 1 and not v] for i in (0, 1) for j in (0, 1)} - outline:
                if holds(rings, (x + 0.5) / (1 << z), (y + 0.5) / (1 << z)):
                    out[(z, x, y)] = True
    return out


def star(rng, n, x, y, r):
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    d = rng.uniform(0.3, 1, n) * r
    pts = [(float(x + k * np.cos(t)), float(y + k * np.sin(t))) for t, k in zip(a, d)]
    return pts + pts[:1]


def text(ring):
    return "(" + ",".join(f"{x!r} {y!r}" for x, y in ring) + ")"


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(2)
    out = [([[(-20.3, 30.1), (40.7, 30.1), (40.7, 60.9), (-20.3, 60.9), (-20.3, 30.1)]], True),
           ([[(-179.9, -84.9), (179.9, -84.9), (179.9, 84.9), (-179.9, 84.9), (-179.9, -84.9)]], True)]
    for _ in range(6):
        x, y = rng.uniform(-120, 120), rng.uniform(-50, 50)
        out.append(([star(rng, 12, x, y, 25), star(rng, 7, x, y, 5)], True))
        out.append(([[tuple(map(float, p)) for p in np.cumsum(rng.normal(0, 6, (9, 2)), axis=0) + (x, y)]], False))
    return out


def frame(spark, shapes):
    rows = [(i, "POLYGON(" + ",".join(map(text, rings)) + ")" if area else "LINESTRING" + text(rings[0])) for i, (rings, area) in enumerate(shapes)]
    return spark.createDataFrame(rows, "fid long, w string").select("fid", F.expr(X.from_wkt("w")).alias("geom"))


def test_shapes_against_brute_force(spark, shapes):
    got = {}
    for r in V.shape_tiles(frame(spark, shapes), LEVELS, "fid").collect():
        got.setdefault(r.fid, {})[(r.z, r.x, r.y)] = r.inside
    for i, (rings, area) in enumerate(shapes):
        assert got[i] == brute(rings, area)


def test_counts_of_all_tiles(spark, shapes):
    """Outline and inside tiles together count, for each tile of a level, the polygons that meet it."""
    areas = [s for s in shapes if s[1]]
    counts = {(r.z, r.x, r.y): (r.cnt, r.inside) for r in V.tile_counts(frame(spark, areas), 7, key="fid").collect()}
    unkeyed = {(r.z, r.x, r.y): (r.cnt, r.inside) for r in V.tile_counts(frame(spark, areas), 7).collect()}
    assert unkeyed == counts
    z = 6
    for x in range(0, 1 << z, 3):
        for y in range(0, 1 << z, 3):
            total = counts.get((z, x, y), (0, 0))[0] + sum(counts.get((z - k, x >> k, y >> k), (0, 0))[1] for k in range(z + 1))
            expected = 0
            for rings, _ in areas:
                rings = [mercator(*np.array(r, float).T) for r in rings]
                expected += any((x, y) in meets(u, v, z) for u, v in rings) or holds(rings, (x + 0.5) / (1 << z), (y + 0.5) / (1 << z))
            assert total == expected, (x, y)


def test_lookup_counts_what_holds_a_tile(spark, shapes):
    pyramid = V.tile_counts(frame(spark, shapes[:2]), 8, key="fid").cache()
    x, y = mercator(10.0, 45.0)
    assert [r.cnt for r in V.tile_lookup(pyramid, 7, int(x * 128), int(y * 128)).collect()] == [2]
    x, y = mercator(100.0, -45.0)
    assert [r.cnt for r in V.tile_lookup(pyramid, 7, int(x * 128), int(y * 128)).collect()] == [1]


def test_a_large_box_costs_its_outline(spark):
    """The outline doubles from level to level, where the area would grow by four, and inside tiles are no more than its own."""
    box = spark.range(1).select(F.col("id").alias("fid"), F.expr(G.box_polygon(3.1, 2.2, 9.7, 8.3)).alias("geom"))
    rows = {r.z: (r.outline, r.inside) for r in V.shape_tiles(box, 16, "fid").groupBy("z").agg(F.count_if(~F.col("inside")).alias("outline"), F.count_if("inside").alias("inside")).collect()}
    assert all(rows[z + 1][0] <= 2.3 * rows[z][0] for z in range(9, 15)) and all(b <= a for a, b in rows.values())
    assert rows[15][0] < 5 * 6.6 / 360 * 2**15


def test_raster_of_lines(spark, shapes):
    lines = [s for s in shapes if not s[1]]
    got = {}
    for r in V.tile_raster(frame(spark, lines), 2, 16, points=False, key="fid").collect():
        got[(r.z, r.x * 16 + r.px, r.y * 16 + r.py)] = r.cnt
    expected = {}
    for rings, _ in lines:
        for z, x, y in brute(rings, False, 6):
            if z >= 4:
                expected[(z - 4, x, y)] = expected.get((z - 4, x, y), 0) + 1
    assert got == expected
    with pytest.raises(Exception, match="No raster of a Polygon"):
        V.tile_raster(frame(spark, shapes[:1]), 2, 16, points=False).collect()
    with pytest.raises(Exception, match="Not a point"):
        V.tile_raster(frame(spark, shapes[:1]), 2, 16).collect()


def _summed(df):
    return {(r.z, r.x, r.y): (r.cnt, r.inside) for r in df.groupBy("z", "x", "y").agg(F.sum("cnt").alias("cnt"), F.sum("inside").alias("inside")).where("cnt <> 0 or inside <> 0").collect()}


def _by_rows(df, levels, key):
    return _summed(V.shape_tiles(df, levels, key).selectExpr("z", "x", "y", "bigint(not inside) AS cnt", "bigint(inside) AS inside"))


def test_counts_follow_small_shapes_where_they_lie(spark):
    """What leaves the tasks are counts of tiles, not the tiles of each shape: shapes of one place are few rows."""
    boxes = spark.range(400).selectExpr("id AS fid", f"{G.box_polygon('10.001D + id % 20 / 1000D', '50.001D', '10.008D + id % 20 / 1000D', '50.007D')} AS geom")
    tiles, counted = V.shape_tiles(boxes, 18, "fid"), V.shape_counts(boxes, 18, "fid")
    assert 10 * counted.count() < tiles.count()
    assert _summed(counted) == _by_rows(boxes, 18, "fid") == _summed(V.shape_counts(boxes, 18))


def test_counts_of_shapes_that_share_a_key(spark):
    """A key's tiles count once, however many rows it has; missing keys are one; parities add up over the rows of a polygon's key."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        x, y = rng.uniform(5, 5.2), rng.uniform(40, 40.2)
        path = [tuple(map(float, p)) for p in np.cumsum(rng.normal(0, 0.01, (4, 2)), axis=0) + (x, y)]
        rows += [(i % 60, "LINESTRING" + text(path))] * (1 + i % 2)
    rows += [(None, "LINESTRING(5.01 40.01, 5.02 40.03)"), (None, "LINESTRING(5.01 40.01, 5.02 40.02)"), (61, "MULTIPOINT((5.1 40.1),(5.1 40.1),(7 9))")]
    rows += [(62, "LINESTRING(-170 -80, 5.1 40.1, 170 80)"), (62, "LINESTRING(5.1 40.1, 5.11 40.1)"), (63, "LINESTRING(0 86, 10 88)"), (64, "LINESTRING(5.1 86, 5.1 40.1)")]
    rows += [(65, "LINESTRING(5.1 40.1, 5.11 40.11)")] * (V.SMALL_ROWS + 1)
    rows += [(66 + i // 2, "POLYGON" + "(" + text(star(rng, 9, 5.1 + i / 500, 40.1, 0.01)) + ")") for i in range(6)]
    rows += [(70, "POLYGON" + "(" + text(star(rng, 9, 5.1, 40.1, 0.02)) + "," + text(star(rng, 5, 5.1, 40.1, 0.004)) + ")"), (71, None), (72, "POLYGON((5 40, 5.02 40, 5.02 40.02, 5 40.02, 5 40))")]
    df = spark.createDataFrame(rows, "fid long, w string").select("fid", F.expr(X.from_wkt("w")).alias("geom")).repartition(5)
    df = df.cache()
    assert _summed(V.shape_counts(df, 14, "fid")) == _by_rows(df, 14, "fid")
    assert _summed(V.shape_counts(df, 14)) == _by_rows(df, 14, None)

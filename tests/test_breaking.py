import math

import pytest
from pyspark.sql import functions as F

from mapshelf.functions import textgeom as X
from mapshelf.operators import breaking as K


def vertices(n, start=0):
    return ",".join(f"{start + i}.0 {(start + i) % 2}.0" for i in range(n))


def broken(spark, wkt, t):
    df = spark.createDataFrame([(wkt,)], "w string").select(F.expr(X.from_wkt("w")).alias("geom"))
    out = K.break_geometries(df, t, position="n").select("n", F.expr(X.to_wkt("geom")).alias("w")).orderBy("n")
    return [r.w for r in out.collect()]


def test_polygon_becomes_two_chunks(spark):
    ring = [(math.cos(2 * math.pi * i / 18), math.sin(2 * math.pi * i / 18)) for i in range(18)]
    ring.append(ring[0])
    wkt = "POLYGON((" + ",".join(f"{x!r} {y!r}" for x, y in ring) + "))"
    df = spark.createDataFrame([(wkt,)], "w string").select(F.expr(X.from_wkt("w")).alias("geom"))
    rows = K.break_geometries(df, 10, position="n").orderBy("n").collect()
    got = [[(v.x, v.y) for v in r.geom.parts[0].rings[0]] for r in rows]
    assert got == [ring[:10], ring[9:]]
    assert [r.geom.kind for r in rows] == ["LineString", "LineString"]


@pytest.mark.parametrize("n,t,sizes", [(10, 10, [10]), (11, 10, [10, 2]), (19, 10, [10, 10]), (20, 10, [10, 10, 2]), (5, 5, [5]), (9, 5, [5, 5])])
def test_line_chunks(spark, n, t, sizes):
    out = broken(spark, f"LINESTRING({vertices(n)})", t)
    assert [w.count(",") + 1 for w in out] == sizes
    for a, b in zip(out, out[1:]):
        assert a[:-1].rsplit(",")[-1].split("(")[-1] == b.split("(")[1].split(",")[0].rstrip(")")


def test_breadth_first_order(spark):
    small = "((0.0 0.0,1.0 0.0,1.0 1.0,0.0 0.0))"
    big = f"(({vertices(7)},0.0 0.0),(0.1 0.1,0.2 0.1,0.2 0.2,0.1 0.1))"
    out = broken(spark, f"MULTIPOLYGON({big},{small})", 5)
    assert [w.split("(")[0] for w in out] == ["POLYGON", "LINEARRING", "LINESTRING", "LINESTRING"]
    out = broken(spark, f"GEOMETRYCOLLECTION(POLYGON{big},LINESTRING({vertices(6, 50)}),POINT(9.0 9.0))", 5)
    assert [w.split("(")[0] for w in out] == ["POINT", "LINEARRING", "LINESTRING", "LINESTRING", "LINESTRING", "LINESTRING"]
    assert out[2].startswith("LINESTRING(50.0")


def test_small_and_empty(spark):
    assert broken(spark, "MULTIPOINT((1 1),(2 2))", 5) == ["MULTIPOINT((1.0 1.0),(2.0 2.0))"]
    assert broken(spark, "POLYGON EMPTY", 5) == []
    assert broken(spark, f"MULTIPOINT({vertices(6)})", 5)[0] == "POINT(0.0 0.0)"
    with pytest.raises(ValueError):
        broken(spark, "POINT(1 1)", 4)


def test_viz_features(spark):
    rows = [("POINT(0 0)",), ("POINT(0 86)",), (None,), ("POINT EMPTY",), ("LINESTRING(0 80,0 89)",), ("POINT(181 0)",)]
    df = spark.createDataFrame(rows, "w string").select(F.lit(1).alias("a"), F.expr(X.from_wkt("w")).alias("geom"))
    out = K.viz_features(df)
    assert "a" not in out.columns
    assert sorted(r.w for r in out.select(F.expr(X.to_wkt("geom")).alias("w")).collect()) == ["LINESTRING(0.0 80.0,0.0 89.0)", "POINT(0.0 0.0)"]

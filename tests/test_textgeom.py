import json

import pytest
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions import textgeom as X

CASES = [
    "POINT(1.5 -2.25)",
    "LINESTRING(0.0 0.0,1.0 1.0,2.0 0.5)",
    "POLYGON((0.0 0.0,4.0 0.0,4.0 4.0,0.0 0.0),(1.0 1.0,2.0 1.0,2.0 2.0,1.0 1.0))",
    "MULTIPOINT((1.0 2.0),(3.0 4.0))".replace("(1.0 2.0),(3.0 4.0)", "(1.0 2.0),(3.0 4.0)"),
    "MULTILINESTRING((0.0 0.0,1.0 1.0),(5.0 5.0,6.0 6.0,7.0 7.0))",
    "MULTIPOLYGON(((0.0 0.0,4.0 0.0,4.0 4.0,0.0 0.0)),((9.0 9.0,10.0 9.0,10.0 10.0,9.0 9.0),(9.1 9.1,9.2 9.1,9.2 9.2,9.1 9.1)))",
    "GEOMETRYCOLLECTION(POINT(1.0 2.0),LINESTRING(0.0 0.0,1.0 1.0))",
    "POINT EMPTY",
    "POLYGON EMPTY",
]


def test_wkt_and_geojson_round_trip(spark):
    df = spark.createDataFrame([(w,) for w in CASES], "w string")
    rows = df.select("w", F.expr(X.from_wkt("w")).alias("g")).select(
        "w", F.expr(X.to_wkt("g")).alias("w2"), F.expr(X.to_geojson("g")).alias("j")).select(
        "*", F.expr(X.from_geojson("j")).alias("g3")).select("*", F.expr(X.to_wkt("g3")).alias("w3")).collect()
    for row in rows:
        assert (row.w2, row.w3) == (row.w, row.w)
        json.loads(row.j)


def test_wkt_loose_spelling(spark):
    rows = spark.createDataFrame([
        ("  point ( 1e1   2E-1 )",), ("Point Z (1 2 3)",), ("MULTIPOINT(1 2, 3 4)",),
        ("SRID=4326;POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))",), (None,), (" ",)],
        "w string").select(F.expr(X.to_wkt(X.from_wkt("w"))).alias("w")).collect()
    assert [r.w for r in rows] == [
        "POINT(10.0 0.2)", "POINT(1.0 2.0)", "MULTIPOINT((1.0 2.0),(3.0 4.0))",
        "POLYGON((0.0 0.0,1.0 0.0,1.0 1.0,0.0 0.0),(0.1 0.1,0.2 0.1,0.2 0.2,0.1 0.1))", None, None]


def test_wkt_errors(spark):
    for bad in ["CIRCLE(1 2)", "POINT 1 2", "nonsense"]:
        with pytest.raises(Exception, match="Unreadable WKT"):
            spark.createDataFrame([(bad,)], "w string").select(F.expr(X.from_wkt("w"))).collect()


def test_measures(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(CASES)], "i int, w string").select(
        "i", F.expr(X.from_wkt("w")).alias("geom"))
    rows = df.select("i", F.expr(G.num_points("geom")).alias("n"), F.expr(G.is_empty("geom")).alias("e"),
                     F.expr(G.mbr("geom")).alias("b")).orderBy("i").collect()
    assert [r.n for r in rows] == [1, 3, 8, 2, 5, 12, 3, 0, 0]
    assert [r.e for r in rows] == [False] * 7 + [True] * 2
    assert tuple(rows[5].b) == (0.0, 0.0, 10.0, 10.0)
    assert tuple(rows[7].b) == (None,) * 4


INTERSECTS = [
    ("POINT(1 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
    ("POINT(2 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),      # on an edge
    ("POINT(2 2)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),      # on a vertex
    ("POINT(3 2)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", False),     # ray through vertices
    ("POINT(-1 2)", "POLYGON((0 0,2 0,4 2,2 4,0 4,0 0))", False),
    ("POINT(1 2)", "POLYGON((0 0,2 0,4 2,2 4,0 4,0 0))", True),  # ray through a vertex
    ("POINT(5 5)", "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))", False),
    ("POINT(4 5)", "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))", True),
    ("LINESTRING(4.5 4.5,5.5 5.5)", "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))", False),
    ("LINESTRING(0 0,4 0)", "LINESTRING(2 0,6 0)", True),        # collinear overlap
    ("LINESTRING(0 0,1 0)", "LINESTRING(2 0,6 0)", False),
    ("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)", True),
    ("LINESTRING(0 0,1 1)", "LINESTRING(1 1,2 0)", True),
    ("POLYGON((0 0,9 0,9 9,0 9,0 0))", "POLYGON((1 1,2 1,2 2,1 2,1 1))", True),
    ("POLYGON((1 1,2 1,2 2,1 2,1 1))", "POLYGON((0 0,9 0,9 9,0 9,0 0))", True),
    ("POLYGON((1 1,2 1,2 2,1 2,1 1))", "POLYGON((3 3,4 3,4 4,3 4,3 3))", False),
    ("MULTIPOINT((9 9),(1 1))", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
    ("POINT EMPTY", "POLYGON((0 0,2 0,2 2,0 2,0 0))", False),
    (None, "POLYGON((0 0,2 0,2 2,0 2,0 0))", False),
    ("POINT(1 1)", "POINT(1 1)", True),
    ("POINT(1 1)", "MULTIPOLYGON(((5 5,6 5,6 6,5 5)),((0 0,2 0,2 2,0 2,0 0)))", True),
]


def test_intersects(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(INTERSECTS)], "i int, a string, b string, e boolean")
    df = df.select("i", "e", F.expr(X.from_wkt("a")).alias("a"), F.expr(X.from_wkt("b")).alias("b"))
    rows = df.select("i", "e", F.expr(G.intersects("a", "b")).alias("ab"),
                     F.expr(G.intersects("b", "a")).alias("ba")).orderBy("i").collect()
    assert [(r.i, r.ab, r.ba) for r in rows] == [(r.i, r.e, r.e) for r in rows]


def test_intersects_box_agrees_with_box_polygon(spark):
    geoms = [c[0] for c in INTERSECTS if c[0]] + [c[1] for c in INTERSECTS]
    boxes = [(0.0, 0.0, 1.0, 1.0), (2.0, 2.0, 3.0, 3.0), (4.6, 4.6, 5.0, 5.0), (-5.0, -5.0, -1.0, -1.0),
             (4.2, 5.0, 4.2, 5.0), (1.0, 0.0, 1.0, 3.0)]
    df = spark.createDataFrame([(g,) for g in geoms], "w string").select("w", F.expr(X.from_wkt("w")).alias("g"))
    boxed = spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double")
    corners = ("x0", "y0", "x1", "y1")
    rows = df.join(boxed).select("*", F.expr(G.box_polygon(*corners)).alias("b")).select(
        "w", "x0", "y0", F.expr(G.intersects_box("g", corners)).alias("fast"),
        F.expr(G.intersects("g", "b")).alias("slow")).collect()
    assert [r for r in rows if r.fast != r.slow] == []


def test_kml(spark):
    row = spark.createDataFrame([("POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))",)], "w string").select(
        F.expr(X.to_kml(X.from_wkt("w"))).alias("k")).first()
    assert row.k.startswith("<Polygon><outerBoundaryIs><LinearRing><coordinates>0.0,0.0 4.0,0.0")
    assert row.k.count("innerBoundaryIs") == 2

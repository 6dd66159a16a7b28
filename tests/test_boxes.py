import pytest
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions import textgeom as X
from mapshelf.operators import boxes as B
from mapshelf.operators import spatial_filter as Q

CASES = [
    ("-10,0,10,5", False, [(-10, 0, 10, 5)]),
    ("170,0,190,5", False, [(170, 0, 180, 5), (-180, 0, -170, 5)]),
    ("-200,0,250,5", False, [(-180, 0, 180, 5)]),
    ("-180,0,180,5", False, [(-180, 0, 180, 5)]),
    ("-180,0,180,5", True, [(-180, 0, -180, 5)]),
    ("0,0,360,5", True, [(0, 0, 0, 5)]),
    ("540,0,545,5", False, [(-180, 0, -175, 5)]),
    ("3,0,3,5", False, [(3, 0, 3, 5)]),
]


def test_boxes(spark):
    for strict in (False, True):
        cases = [c for c in CASES if c[1] == strict]
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, m string").select(
            "i", B.normalize_mbr(B.parse_mbr(F.col("m")), strict).alias("b")).orderBy("i")
        assert [[tuple(b) for b in r.b] for r in df.collect()] == [[tuple(map(float, b)) for b in c[2]] for c in cases]
        assert [B.query_boxes(c[0], strict) for c in cases] == [[tuple(map(float, b)) for b in c[2]] for c in cases]


@pytest.fixture(scope="module")
def features(spark):
    rows = [(1, "POINT(175 1)"), (2, "POINT(-175 1)"), (3, "LINESTRING(0 0,10 10)"), (4, None), (5, "POINT EMPTY"),
            (6, "POLYGON((20 20,40 20,40 40,20 40,20 20),(25 25,35 25,35 35,25 35,25 25))"), (7, "MULTIPOINT((50 50),(60 60))")]
    return spark.createDataFrame(rows, "fid int, w string").select("fid", F.concat(F.lit("n"), "fid").alias("name"), F.expr(X.from_wkt("w")).alias("geom"))


def ids(df):
    return sorted(r.fid for r in df.select("fid").collect())


def test_range_query(features):
    def hit(mbr):
        return ids(Q.range_query(features, mbr))
    assert hit("170,0,190,5") == [1, 2]
    assert hit("175,1,175,1") == [1]
    assert hit("0,5,4,10") == []              # box of the line, not the line
    assert hit("0,5,5,10") == [3]             # touches it in one point
    assert hit("26,26,34,34") == []           # in the hole
    assert hit("26,26,35,34") == [6]          # touches the hole's edge
    assert hit("21,21,22,22") == [6]          # inside the polygon
    assert hit("52,52,58,58") == []
    assert hit("-180,-90,180,90") == [1, 2, 3, 6, 7]


def test_view(features):
    def view(**kw):
        return Q.view_feature(features, ["fid"], **kw).collect()[0].record
    assert view(mbr="170,0,190,5") == '{"name":"n1"}'
    assert view(mbr="170,0,190,5", extents=True) == '{"name":"n1","extents":[175.0,1.0,175.0,1.0]}'
    assert view() == '{"name":"n1"}'
    assert view(mbr="100,0,101,1") == '{"out_bound":1}'
    assert view(mbr="0,0,1,1", fmt="GeoJSON") == '{"type":"Feature","properties":{"name":"n3"},"geometry":{"type":"LineString","coordinates":[[0.0,0.0],[10.0,10.0]]}}'
    assert Q.view_feature(features.select("fid", "geom"), ["fid"], "170,0,190,5").first().record == "{}"


def test_box_filter_reaches_the_reader(spark, tmp_path):
    spark.range(1000).select("id", F.col("id").cast("double").alias("x")).select(
        "id", F.expr(G.point("x", 0)).alias("geom"), F.col("x").alias("xmin"), F.lit(0.0).alias("ymin"),
        F.col("x").alias("xmax"), F.lit(0.0).alias("ymax")).write.parquet(str(tmp_path / "f"))
    df = Q.range_query(spark.read.parquet(str(tmp_path / "f")), "5,-1,8,1", points=True).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(xmin,8.0)" in plan and "GreaterThanOrEqual(xmax,5.0)" in plan
    assert "geom" not in plan.split("ReadSchema:")[1]
    assert df.count() == 4

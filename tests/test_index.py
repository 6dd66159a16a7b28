import numpy as np
import pytest
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.operators import catalog as C
from mapshelf.operators import indexing as I
from mapshelf.operators import partitioning as P
from mapshelf.operators import sinks as S
from mapshelf.operators import spatial_filter as Q
from mapshelf.operators import summary as A
from mapshelf.operators import tiles as V
from mapshelf.plans import download as W
from mapshelf.plans import ingest as N


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1, (1000, 2)).round(4)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "fid long, x double, y double")
    return df.select("fid", F.expr(G.point("x", "y")).alias("geom")).cache()


@pytest.mark.parametrize("method", ["rsgrove", "grid", "str", "zcurve"])
def test_partitioners(points, method):
    placed = P.spatial_partition(points, method, parts=16)
    rows = placed.groupBy("part_id").agg(F.count("*").alias("n"), F.count_distinct("fid").alias("d")).collect()
    assert sum(r.n for r in rows) == 1000 == sum(r.d for r in rows)
    assert 8 <= len(rows) <= 16 and max(r.n for r in rows) <= 150
    with pytest.raises(ValueError):
        P.spatial_partition(points, "other")


def test_split_tree_on_skewed_data(spark):
    """A third of all rows share one place: that place is one part and the others stay balanced."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(1000, 0.5), rng.uniform(0, 1, 2000)])
    y = np.concatenate([np.full(1000, 0.5), rng.uniform(0, 1, 2000)])
    tree = P.build_split_tree(x, y, np.ones(3000), 12)
    found = tree.locate(x, y)
    sizes = np.bincount(found)
    assert len(set(found[:1000])) == 1 and sizes.sum() == 3000
    others = np.delete(sizes, found[0])
    assert others.max() <= 600


def test_index_round_trip_and_pruning(spark, points, tmp_path):
    path = str(tmp_path / "i")
    I.build_index(points, path, parts=16)
    indexed, master = I.read_index(spark, path), I.read_master(spark, path)
    assert indexed.count() == 1000 and master.agg(F.sum("record_count")).first()[0] == 1000
    pruned = Q.prune_partitions(master, [(0.0, 0.0, 0.2, 0.2)])
    assert 0 < pruned.count() < master.count() / 2
    found = Q.indexed_range_query(indexed, master, "0,0,0.2,0.2")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    plain = Q.range_query(points, "0,0,0.2,0.2")
    assert sorted(r.fid for r in found.collect()) == sorted(r.fid for r in plain.collect())
    with pytest.raises(FileExistsError):
        I.build_index(points, path, overwrite=False)
    I.build_index(points.limit(10), path, parts=2)
    assert I.read_index(spark, path).count() == 10


@pytest.mark.parametrize("fmt,key", [("csv", None), ("json", None), ("geojson", None), ("geojson", "fid"), ("kml", None)])
def test_export_keeps_the_part_size(spark, points, tmp_path, monkeypatch, fmt, key):
    """Every format is cut into files of about the bytes asked for, by the mean of all records."""
    monkeypatch.setattr(S, "records_per_part", lambda df: 100)
    S.write_features(points.select("fid", "geom").coalesce(1), str(tmp_path / "out"), fmt, key=key, bounded=True)
    files = [f for f in (tmp_path / "out").rglob("part-*") if f.is_file() and f.stat().st_size > 200]
    assert len(files) >= 10 and all(len(f.read_text().splitlines()) <= 100 for f in files)


def test_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    """The rebalance hint cuts an oversized part; the rows stay whole."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        df = spark.range(20000).repartition(8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t"), F.expr(G.point(1, 2)).alias("geom"))
        I.save_index(df.withColumn("part_id", F.lit(0)), str(tmp_path / "hot"))
        files = list((tmp_path / "hot" / "data" / "part_id=0").glob("*.parquet"))
        assert len(files) > 1 and I.read_index(spark, str(tmp_path / "hot")).select("id").distinct().count() == 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_summary_of_mixed_rows(spark):
    from mapshelf.functions import textgeom as X
    rows = [(1, "ab", "POINT(1 2)"), (2, None, "LINESTRING(0 0,2 4)"), (3, "c", None), (4, "d", "POINT EMPTY")]
    df = spark.createDataFrame(rows, "fid int, a string, w string").select("fid", "a", F.expr(X.from_wkt("w")).alias("geom"))
    s = A.summarize(df, key="fid").first()
    assert (s["size"], s.num_features, s.num_points, s.geometry_type) == (3 * 16 + 4, 4, 3, "GeometryCollection")
    assert s.extent == [0.0, 0.0, 2.0, 4.0] and s.avg_sidelength == [1.0, 2.0]
    empty = A.summarize(df.where("fid = 3"), key="fid").first()
    assert empty.extent is None and empty.geometry_type is None and empty.num_points == 0
    kinds = [(r.name, r.type) for r in A.attribute_types(df.where("fid > 1"), "fid").collect()]
    assert kinds == [("fid", "integer"), ("a", "unknown")]
    assert A.attribute_types(df.select("geom"), "fid").count() == 0


def test_tiles(spark, points):
    by_rollup = V.tile_counts(points, 12, points=True)
    direct = V.tile_counts(points, 12).drop("inside")
    assert by_rollup.exceptAll(direct).isEmpty() and direct.exceptAll(by_rollup).isEmpty()
    assert {r.z: r.n for r in by_rollup.groupBy("z").agg(F.sum("cnt").alias("n")).collect()} == {z: 1000 for z in range(12)}
    edge = spark.createDataFrame([(1, 180.0, 85.0511287798066), (2, -180.0, -85.0511287798066), (3, 0.0, 86.0)], "fid int, x double, y double").select(
        "fid", F.expr(G.point("x", "y")).alias("geom"))
    got = sorted(tuple(r) for r in V.assign_tiles(edge, 3).where("z = 2").collect())
    assert got == [(1, 2, 3, 0), (2, 2, 0, 3)]
    box = spark.range(1).select(F.col("id").alias("fid"), F.expr(G.box_polygon(-1, -1, 1, 1)).alias("geom"))
    assert V.tile_counts(box, 2).where("z = 1").count() == 4
    px = V.tile_raster(points, 3)
    assert {r.z: r.n for r in px.groupBy("z").agg(F.sum("cnt").alias("n")).collect()} == {0: 1000, 1: 1000, 2: 1000}


def test_sinks(spark, points, tmp_path):
    import json
    S.write_features(points, str(tmp_path / "c"), "csv", points=True, sep=";")
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert len(lines) == 1000 and all(line.count(";") == 2 for line in lines)
    S.write_features(points, str(tmp_path / "g"), "GeoJSON", key="fid")
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").rglob("part-*")))
    parsed = json.loads(text)
    assert sorted(f["properties"]["fid"] for f in parsed["features"]) == list(range(1000))
    S.write_features(points, str(tmp_path / "k"), "kmz")
    kml = "".join(p.read_text() for p in sorted((tmp_path / "k").rglob("part-*")))
    assert kml.startswith("<?xml") and kml.rstrip().endswith("</kml>") and kml.count("<Placemark>") == 1000
    import xml.etree.ElementTree as ET
    ET.fromstring(kml)
    with pytest.raises(ValueError, match="Unrecognized extension 'xyz'"):
        S.write_features(points, str(tmp_path / "x"), "xyz.gz")
    assert S.records_per_part(points, 1000) >= 1


@pytest.mark.parametrize("levels", [6])
def test_ingest(spark, points, tmp_path, levels):
    import zipfile
    base = str(tmp_path / "archive")
    folder = tmp_path / "archive" / "rand" / "points" / "download"
    folder.mkdir(parents=True)
    rows = points.select(F.expr(G.xmin("geom")).alias("x"), F.expr(G.ymin("geom")).alias("y"), "fid").collect()
    with zipfile.ZipFile(folder / "data.zip", "w") as z:
        z.writestr("p.csv", "".join(f"{r.x};{r.y};{r.fid}\n" for r in rows))
    table = C.CatalogTable(spark, str(tmp_path / "cat"))
    table.insert(spark.createDataFrame([("rand/points", "created", {"iformat": "point", "separator": ";"}), ("missing", "created", {"iformat": "point"})],
                                       "name string, status string, options map<string,string>"))
    results = N.process_pending(table, N.Run(base, {"separator": ","}, levels=levels))
    assert "ready" in results
    done = C.find_by_name(table.read(), "rand/points").first()
    assert (done.status, done.num_features, done.num_points, done.geometry_type) == ("ready", 1000, None, "Point")
    assert done.index_path == "rand/points/data_index" and done.visualization.type == "Vector"
    assert [(a.name, a.type) for a in done.attributes] == [("_c2", "string")]
    assert C.find_by_name(table.read(), "missing").first().status == "created-error"
    assert N.reindex(table, done["_id"], N.Run(base)) == "indexed"
    W.download(spark, f"{base}/rand/points/data_index", str(tmp_path / "out"), "csv.gz", mbr="0,0,0.5,0.5", points=True)
    n = sum(1 for r in rows if r.x <= 0.5 and r.y <= 0.5)
    assert spark.read.text(str(tmp_path / "out")).count() == n
    big = N.tile_stage(spark, f"{base}/rand/points", "rand/points", 1 << 21, True, N.Run(base, levels=levels))
    assert big[0] == "Tile" and spark.read.parquet(f"{base}/rand/points/plot").where("z = 0").first().cnt == 1000

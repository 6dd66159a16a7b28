import json
import zipfile

import pytest
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions import textgeom as X
from mapshelf.operators.indexing import read_text_master
from mapshelf.sources import archives, loose_json, readers


def wkts(df):
    return sorted(r.w for r in df.select(F.expr(X.to_wkt("geom")).alias("w")).collect())


def test_csv_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;lon;lat\n"a;b";1;2\nc;3.5;4\n')
    df = readers.read_dataset(spark, str(tmp_path), {"iformat": "point(lon,lat)", "separator": ";", "skipheader": "true"})
    assert wkts(df) == ["POINT(1.0 2.0)", "POINT(3.5 4.0)"]
    assert sorted(r.name for r in df.collect()) == ["a;b", "c"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.csv").write_text("1,x\n")
    with pytest.raises(Exception):
        readers.read_csv_points(spark, str(tmp_path / "bad")).collect()
    with pytest.raises(ValueError):
        readers.read_dataset(spark, str(tmp_path), {"iformat": "nothing"})


def test_csv_wkt_and_segments(spark, tmp_path):
    (tmp_path / "w.csv").write_text('1\tPOINT(1 2)\n2\t"LINESTRING(0 0,1 1)"\n')
    assert wkts(readers.read_dataset(spark, str(tmp_path / "w.csv"), {"iformat": "wkt(1)", "separator": "\t"})) == [
        "LINESTRING(0.0 0.0,1.0 1.0)", "POINT(1.0 2.0)"]
    (tmp_path / "s.csv").write_text('4,"x, y",1,,3,2\n')
    row = readers.read_csv_segments(spark, str(tmp_path / "s.csv"), "2,5,4,0").select("_c1", "_c3", F.expr(X.to_wkt("geom")).alias("w")).first()
    assert tuple(row) == ("x, y", "", "LINESTRING(1.0 2.0,3.0 4.0)")


def test_geolife(spark, tmp_path):
    head = "\n".join(f"h{i}" for i in range(6))
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.plt").write_text(head + "\n39.9,116.3,0,492,39744.12,2008-10-23,02:53:04\n39.8,116.4,0,490,39744.13,2008-10-23,02:53:10\n")
    (tmp_path / "u" / "notes.txt").write_text("not a trace")
    df = readers.read_dataset(spark, str(tmp_path), {"iformat": "geolife"})
    assert df.columns == ["geom", "Unused", "Altitude", "Date_Days", "Date", "Time"]
    assert wkts(df) == ["POINT(116.3 39.9)", "POINT(116.4 39.8)"]
    (tmp_path / "u" / "b.plt").write_text(head + "\n39.9,116.3,0\n")
    with pytest.raises(Exception):
        readers.read_geolife(spark, str(tmp_path)).collect()


def test_porto(spark, tmp_path):
    names = "TRIP_ID,CALL_TYPE,ORIGIN_CALL,ORIGIN_STAND,TAXI_ID,TIMESTAMP,DAY_TYPE,MISSING_DATA,POLYLINE".split(",")
    rows = [names,
            ["901", "C", "", "", "35", "1500000321", "A", "False", "[[-8.6,41.1],[-8.5,41.2]]"],
            ["902", "B", "", "8", "36", "1500000987", "A", "True", "[[-8.6,41.1]]"],
            ["903", "B", "", "", "36", "1500001234", "A", "False", "[]"]]
    (tmp_path / "p.txt").write_text("\n".join(",".join(f'"{v}"' for v in r) for r in rows) + "\n")
    df = readers.read_dataset(spark, str(tmp_path), {"iformat": "porto"})
    got = df.select("TRIP_ID", "ORIGIN_CALL", "ORIGIN_STAND", "TAXI_ID", F.unix_millis("TIMESTAMP").alias("t"), "MISSING_DATA",
                    F.expr(G.num_points("geom")).alias("n"), F.col("geom")["kind"].alias("k")).orderBy("TRIP_ID").collect()
    assert [tuple(r) for r in got] == [
        (901, "", "", 35, 1500000321, False, 2, "MultiPoint"), (902, "", "8", 36, 1500000987, True, 1, "MultiPoint"),
        (903, "", "", 36, 1500001234, False, 0, "MultiPoint")]
    assert readers.read_porto(spark, str(tmp_path), "s").select(F.unix_seconds("TIMESTAMP").alias("t")).orderBy("t").first().t == 1500000321
    (tmp_path / "p.txt").write_text("\n".join(",".join(f'"{v}"' for v in r) for r in [names, rows[1][:-1] + ["[[1,2],[3]]"]]) + "\n")
    with pytest.raises(Exception, match="even number"):
        readers.read_porto(spark, str(tmp_path)).collect()


def test_geojson(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"a": 1, "b": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2, 9]}},
        {"type": "Feature", "properties": {"a": None}, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": [
            {"type": "Point", "coordinates": [1, 2]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(fc, indent=1))
    df = readers.read_geojson(spark, str(tmp_path / "a.geojson"))
    rows = df.select("properties", F.expr(X.to_wkt("geom")).alias("w")).collect()
    assert [r.w for r in rows] == ["POINT(1.0 2.0)", None,
                                  "GEOMETRYCOLLECTION(POINT(1.0 2.0),LINESTRING(0.0 0.0,1.0 1.0),LINESTRING(2.0 2.0,3.0 3.0))"]
    assert rows[0].properties == {"a": "1", "b": "x"}
    typed = readers.read_geojson(spark, str(tmp_path / "a.geojson"), "struct<a:bigint,b:string>")
    assert typed.columns == ["a", "b", "geom"]


def test_geojson_lines(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(
        '{\n"type": "FeatureCollection",\n"crs": { "a": {} },\n"features": [\n'
        '{ "type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]} },\n'
        '{ "properties": {"a": 2}, "geometry": null, "type": "Feature" }\n]\n}\n')
    (tmp_path / "b.geojson").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":3},"geometry":{"type":"Point","coordinates":[3,4]}}]}\n')
    df = readers.read_geojson(spark, str(tmp_path), "struct<a:int>", lines=True)
    assert sorted((r.a, r.w) for r in df.select("a", F.expr(X.to_wkt("geom")).alias("w")).collect() if r.w) == [
        (1, "POINT(1.0 2.0)"), (3, "POINT(3.0 4.0)")]
    assert df.count() == 3
    (tmp_path / "c.geojson").write_text('{"type":"Feature", oops}\n')
    with pytest.raises(Exception):
        readers.read_geojson(spark, str(tmp_path), "struct<a:int>", lines=True).collect()


def test_catalog_json(spark, tmp_path):
    doc = [{"_id": {"$oid": "00aa11bb22cc33dd44ee55ff"}, "name": "wells", "extent": [-3.5, 2.0, 4.5, 9.25], "size": 777, "num_features": 12,
            "status": "published", "modifiedAt": {"$date": "2023-07-08T09:10:11.012Z"}, "readerOptions": {"iformat": "point", "separator": "|"}},
           {"_id": {"$oid": "b"}, "readerOptions": "iformat:point(1,2) -skipheader"}, {"_id": {"$oid": "c"}, "readerOptions": ["iformat:wkt"]}, {"_id": {"$oid": "d"}}]
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    rows = readers.read_catalog_json(spark, str(tmp_path / "c.json"), "readerOptions").select("*", F.unix_millis("modifiedAt").alias("ms")).collect()
    row = rows[0]
    assert [r["options"] for r in rows[1:]] == [{"iformat": "point(1,2)", "skipheader": "true"}, {"iformat": "wkt"}, None]
    assert (row["_id"], row["name"], row["extent"], row["options"]) == (
        "00aa11bb22cc33dd44ee55ff", "wells", [-3.5, 2.0, 4.5, 9.25], {"iformat": "point", "separator": "|"})
    assert row.ms == 1688807411012


def test_text_master(spark, tmp_path):
    head = "ID\tFile Name\tRecord Count\tNonEmpty Count\tNumPoints\tData Size\tSum_x\tSum_y\tGeometry\txmin\tymin\txmax\tymax\n"
    (tmp_path / "_master.cells").write_text(head + "0\tpart-0\t10\t0\t0\t74\t0.0\t0.0\tPOLYGON((0 1,2 1,2 3,0 3,0 1))\t0.0\t1.0\t2.0\t3.0\n")
    row = read_text_master(spark, str(tmp_path / "_master.cells")).first()
    assert (row.part_id, row.file_name, row.record_count, row.xmin, row.ymax) == (0, "part-0", 10, 0.0, 3.0)


def test_archives(spark, tmp_path):
    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.txt", "deep")
    folder = tmp_path / "d"
    folder.mkdir()
    with zipfile.ZipFile(folder / "one.two.ZIP", "w") as z:
        z.writestr("sub/", "")
        z.writestr("sub/a.csv", "1,2\n")
        z.write(inner, "inner.zip")
        z.writestr("empty.csv", "")
    (folder / "plain.csv").write_text("3,4\n")
    rows = archives.archive_entries(spark, str(folder)).collect()
    assert sorted((r.folder, r.entry, r.chunk) for r in rows) == [("one.two", "empty.csv", 0), ("one.two", "inner.zip", 0), ("one.two", "sub/a.csv", 0)]
    written = archives.expand_archives(spark, str(folder)).collect()
    assert len(written) == 3
    assert (folder / "one.two" / "sub" / "a.csv").read_text() == "1,2\n"
    assert (folder / "one.two" / "inner.zip").exists() and not (folder / "one.two.ZIP").exists()


def test_archive_entry_outside_its_folder(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../../evil.txt", "x")
    with pytest.raises(Exception, match="outside its folder"):
        archives.expand_archives(spark, str(tmp_path))


def test_loose_json_edges(spark):
    docs = ["not json", "[]", "{}", "3", '{"geometry":{"type":"Sphere"}}',
            '{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}}',
            '[{"geom":0,"shape":{"type":"Point","coordinates":[5,6]},"properties":{"k":[1,{"z":null}]}}]']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, json string")
    out = loose_json.normalize_json_features(df, keep=("i",)).select("i", "properties", F.expr(X.to_wkt("geom")).alias("w"))
    assert sorted(tuple(r) for r in out.collect()) == [
        (5, "{}", "GEOMETRYCOLLECTION(POINT(1.0 2.0))"), (6, '{"k":[1,{"z":null}]}', "POINT(5.0 6.0)")]

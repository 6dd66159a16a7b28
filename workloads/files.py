"""Queries that write derived files below the scratch folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions import textgeom as X
from mapshelf.operators import catalog as C
from mapshelf.operators import archive_index as V
from mapshelf.operators import indexing as I
from mapshelf.operators import partitioning as P
from mapshelf.operators import regions as R
from mapshelf.operators import sinks as S
from mapshelf.operators import spatial_filter as Q
from mapshelf.operators import summary as A
from mapshelf.operators.breaking import DEFAULT_THRESHOLD
from mapshelf.plans import download as W
from mapshelf.plans import ingest as N
from mapshelf.session import materialize, scratch_path
from mapshelf.sources import archives, loose_json, readers
from workloads import derive as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def _xy(df):
    return [F.expr(G.xmin("geom")).alias("x"), F.expr(G.ymin("geom")).alias("y")]


_POINTS_BACK = f"WITH {D.POINTS} SELECT CAST(fid AS VARCHAR) AS fid, o_orderpriority, x, y FROM points"


@query("read_csv_points", _POINTS_BACK)
def read_csv_points(spark, sf):
    """By column name, with a header and a semicolon."""
    path = scratch_path(spark, "csv")
    p = D.points(spark, sf)
    p.select("fid", F.col("xmin").alias("lon"), F.col("ymin").alias("lat"), "o_orderpriority").write.csv(path, sep=";", header=True)
    df = readers.read_dataset(spark, path, {"iformat": "point(lon,lat)", "separator": ";", "skipheader": "true"})
    return df.select("fid", "o_orderpriority", *_xy(df))


@query("read_csv_points_by_index", _POINTS_BACK)
def read_csv_points_by_index(spark, sf):
    path = scratch_path(spark, "csv")
    D.points(spark, sf).select("xmin", "fid", "ymin", "o_orderpriority").write.csv(path)
    df = readers.read_csv_points(spark, path, 0, 2)
    return df.select(F.col("_c1").alias("fid"), F.col("_c3").alias("o_orderpriority"), *_xy(df))


@query("read_csv_wkt", f"""WITH {D.TRIPS}
SELECT CAST(fid AS VARCHAR) AS fid, count(*) AS n_points, min(x) AS xmin, max(y) AS ymax, first(x ORDER BY i) AS first_x FROM trip_vertices GROUP BY fid""")
def read_csv_wkt(spark, sf):
    path = scratch_path(spark, "wkt")
    D.trips(spark, sf).select("fid", F.expr(X.to_wkt("geom")).alias("w")).write.csv(path, sep="\t")
    df = readers.read_dataset(spark, path, {"iformat": "wkt(1)", "separator": "\t"})
    g = F.col("geom")
    return df.select(F.col("_c0").alias("fid"), F.expr(G.num_points("geom")).alias("n_points"), F.expr(G.xmin("geom")).alias("xmin"), F.expr(G.ymax("geom")).alias("ymax"),
                     F.expr(f"get({G.vertices_of('geom')}, 0).x AS first_x"))


@query("read_csv_segments", f"""WITH {D.TRIPS}
SELECT CAST(a.fid AS VARCHAR) AS fid, 'n,' || a.i AS note, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
FROM trip_vertices a JOIN trip_vertices b ON a.fid = b.fid AND b.i = a.i + 1""")
def read_csv_segments(spark, sf):
    """Columns y2, fid, x1, note, y1, x2 with quoted text."""
    path = scratch_path(spark, "segments")
    rows = D.trips(spark, sf).select("fid", F.posexplode(F.expr(G.segments("geom"))).alias("i", "s"))
    rows.select("s.y2", "fid", "s.x1", F.concat(F.lit("n,"), F.col("i").cast("string")).alias("note"), "s.y1", "s.x2").write.csv(path)
    df = readers.read_dataset(spark, path, {"iformat": "csvline", "columns": "2,4,5,0"})
    v = F.expr(G.vertices_of("geom"))
    return df.select(F.col("_c1").alias("fid"), F.col("_c3").alias("note"), *[
        F.get(v, F.lit(i))[k].alias(f"{k}{i + 1}") for i in (0, 1) for k in ("x", "y")])


@query("read_geolife", f"""WITH {D.EVENT_POINTS}
SELECT x, y, '0' AS unused, CAST(user_id AS DOUBLE) AS altitude, CAST(event_id AS DOUBLE) AS days, '2008-10-23' AS date, '02:53:04' AS time FROM event_points""")
def read_geolife(spark, sf):
    """One trace file per 1024 events."""
    path = scratch_path(spark, "geolife")
    e = D.event_points(spark, sf)
    record = F.concat_ws(",", "ymin", "xmin", F.lit("0"), "user_id", "event_id", F.lit("2008-10-23"), F.lit("02:53:04"))
    files = e.select(F.floor(F.col("event_id") / 1024).alias("f"), "event_id", record.alias("r")).groupBy("f").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "r"))).alias("rs"))
    head = "\n".join(f"header {i}" for i in range(6)) + "\n"
    files.select(F.concat(F.lit(head), F.array_join(F.transform("rs", lambda r: r["r"]), "\n"))).write.option(
        "maxRecordsPerFile", 1).text(path)
    df = readers.read_geolife(spark, path, "*.txt")
    return df.select(*_xy(df), F.col("Unused").alias("unused"), F.col("Altitude").alias("altitude"), F.col("Date_Days").alias("days"),
                     F.col("Date").alias("date"), F.col("Time").alias("time"))


@query("read_porto", f"""WITH {D.TRIPS}
SELECT fid AS trip_id, '' AS origin_call, CAST(fid % 7 AS INTEGER) AS taxi_id, 1372637303 + fid AS epoch_ms, fid % 2 = 0 AS missing_data,
       CASE WHEN fid % 5 = 0 THEN 0 ELSE count(*) END AS n_points, CASE WHEN fid % 5 <> 0 THEN min(x) END AS xmin FROM trip_vertices GROUP BY fid""")
def read_porto(spark, sf):
    path = scratch_path(spark, "porto")
    t = D.trips(spark, sf)
    line = F.to_json(F.transform(F.expr(G.vertices_of("geom")), lambda v: F.array(v["x"], v["y"])))
    t.select(F.col("fid").alias("TRIP_ID"), F.lit("B").alias("CALL_TYPE"), F.lit("").alias("ORIGIN_CALL"), F.lit("7").alias("ORIGIN_STAND"),
             (F.col("fid") % 7).alias("TAXI_ID"), (F.col("fid") + 1372637303).alias("TIMESTAMP"), F.lit("A").alias("DAY_TYPE"),
             F.when(F.col("fid") % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("MISSING_DATA"),
             F.when(F.col("fid") % 5 == 0, F.lit("[]")).otherwise(line).alias("POLYLINE")).write.csv(
                 path, header=True, quoteAll=True, emptyValue="")
    df = readers.read_dataset(spark, path, {"iformat": "porto"})
    g = F.col("geom")
    return df.select(F.col("TRIP_ID").alias("trip_id"), F.col("ORIGIN_CALL").alias("origin_call"), F.col("TAXI_ID").alias("taxi_id"),
                     F.unix_millis("TIMESTAMP").alias("epoch_ms"), F.col("MISSING_DATA").alias("missing_data"),
                     F.expr(G.num_points("geom")).alias("n_points"), F.expr(G.xmin("geom")).alias("xmin"))


@query("read_geojson", f"WITH {D.POINTS} SELECT fid, o_orderpriority, x, y FROM points")
def read_geojson(spark, sf):
    """Compressed files with one feature per line."""
    path = scratch_path(spark, "geojson")
    S.write_features(D.points(spark, sf), path, "geojson.gz")
    df = readers.read_geojson(spark, path, "struct<fid:bigint,o_orderpriority:string>", lines=True)
    return df.select("fid", "o_orderpriority", *_xy(df))


@query("read_geojson_collections", f"WITH {D.POINTS} SELECT CAST(fid AS VARCHAR) AS fid, x, y FROM points")
def read_geojson_collections(spark, sf):
    """FeatureCollection files of 1024 features."""
    path = scratch_path(spark, "collections")
    p = D.points(spark, sf).select("fid", "geom")
    bunch = p.select(F.floor(F.col("fid") / 1024).alias("b"), Q.feature_json(p).alias("f")).groupBy("b").agg(F.collect_list("f").alias("fs"))
    bunch.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs", ","), F.lit("]}"))).write.option(
        "maxRecordsPerFile", 1).text(path)
    df = readers.read_dataset(spark, path, {"iformat": "geojson"})
    return df.select(F.col("properties")["fid"].alias("fid"), *_xy(df))


@query("read_geojson_document", f"WITH {D.POINTS} SELECT fid, o_orderpriority, x, y FROM points")
def read_geojson_document(spark, sf):
    """One collection written by many tasks and read by many tasks."""
    path = scratch_path(spark, "document")
    S.write_features(D.points(spark, sf), path, "geojson", key="fid")
    df = readers.read_geojson(spark, path, "struct<fid:bigint,o_orderpriority:string>", lines=True)
    return df.select("fid", "o_orderpriority", *_xy(df))


@query("read_catalog_json", f"""WITH {D.CATALOG} SELECT _id, name, size, lang || ',' || source AS tags,
  strftime(modifiedAt, '%Y-%m-%d %H:%M:%S') AS modified, 'point(0,1)' AS iformat FROM catalog""")
def read_catalog_json(spark, sf):
    """Document arrays of 64 datasets per file."""
    path = scratch_path(spark, "catalog")
    doc = F.to_json(F.struct(
        F.struct(F.col("_id").alias("$oid")).alias("_id"), "name", "size", "tags",
        F.struct(F.date_format("modifiedAt", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("$date")).alias("modifiedAt"),
        F.create_map(F.lit("iformat"), F.lit("point(0,1)")).alias("options")))
    c = D.catalog(spark, sf).select(F.floor(F.conv(F.ltrim("_id"), 16, 10).cast("long") / 64).alias("b"), doc.alias("d"))
    c.groupBy("b").agg(F.collect_list("d").alias("ds")).select(
        F.concat(F.lit("["), F.array_join("ds", ","), F.lit("]"))).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_catalog_json(spark, path).select(
        "_id", "name", "size", F.array_join("tags", ",").alias("tags"),
        F.date_format("modifiedAt", "yyyy-MM-dd HH:mm:ss").alias("modified"), F.col("options")["iformat"].alias("iformat"))


@query("archive_entries", f"""WITH {D.EVENT_POINTS}, f AS (SELECT event_id // 64 AS fid, string_agg(x || ',' || y || chr(10), '' ORDER BY event_id) AS t
  FROM event_points GROUP BY 1)
SELECT 'a' || fid // 16 AS folder, 'trips/' || fid || '.csv' AS entry, CAST(length(t) AS INTEGER) AS n_bytes, md5(t) AS digest FROM f""")
def archive_entries(spark, sf):
    """Zip files of 16 trip texts each, with a folder entry that has to be skipped."""
    path = scratch_path(spark, "zips")
    _write_zips(_trip_texts(spark, sf), path)
    rows = archives.archive_entries(spark, path)
    return rows.select("folder", "entry", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("digest"))


def _trip_texts(spark, sf):
    """(z, fid, t): text of each trip and the archive it goes to."""
    e = D.event_points(spark, sf).selectExpr("event_id div 64 AS fid", "event_id", "concat(xmin, ',', ymin, '\\n') AS t")
    texts = e.groupBy("fid").agg(F.expr("array_join(transform(array_sort(collect_list(struct(event_id, t))), _r -> _r.t), '') AS t"))
    return texts.selectExpr("concat('a', fid div 16) AS z", "fid", "t")


def _write_zips(rows, path: str) -> None:
    """One zip per ``z`` (at most 16 short texts), written by the tasks into a shared folder."""
    import pandas as pd
    root = path[len("file:"):] if path.startswith("file:") else path

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        import os
        import uuid
        import zipfile
        os.makedirs(root, exist_ok=True)
        draft = f"{root}/.{uuid.uuid4().hex}"
        with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("trips/", "")
            for r in group.itertuples():
                z.writestr(f"trips/{r.fid}.csv", r.t)
        os.replace(draft, f"{root}/{group.z.iloc[0]}.ZIP")
        return pd.DataFrame({"n": [len(group)]})

    materialize(rows.groupBy("z").applyInPandas(pack, "n long"), "packed")


@query("loose_json", """SELECT c_custkey AS k, 0 AS position, CASE c_custkey % 8 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"OBJECTID":7,"name":"n' || c_custkey || '"}'
    WHEN 2 THEN '{}' WHEN 3 THEN '{"b":true}' WHEN 4 THEN '{}' WHEN 6 THEN '{"c":null}' WHEN 7 THEN '{}' END AS properties,
  'POINT(' || CAST(c_custkey AS DOUBLE) || ' 1.5)' AS wkt FROM customer WHERE c_custkey % 8 <> 5
UNION ALL SELECT c_custkey, 1, '{}', 'LINESTRING(0.0 0.0,1.0 ' || CAST(c_custkey AS DOUBLE) || ')' FROM customer WHERE c_custkey % 8 IN (2, 4)""")
def loose_json_query(spark, sf):
    """Eight shapes of documents, one of them without any geometry."""
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 8
    pt = F.concat(F.lit('{"type":"Point","coordinates":['), key, F.lit(",1.5]}"))
    ln = F.concat(F.lit('{"type":"LineString","coordinates":[[0,0],[1,'), key, F.lit("]]}"))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    doc = (
        F.when(kind == 0, text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":1},"geometry":', pt, '},{"x":1}]}'))
        .when(kind == 1, text('{"results":[{"OBJECTID":7,"name":"n', key, '","the_geom":', pt, '}]}'))
        .when(kind == 2, text('[{"geom":', pt, '},{"shape":', ln, ',"properties":{}}]'))
        .when(kind == 3, text('{"type":"Feature","properties":{"b":true},"geometry":', pt, '}'))
        .when(kind == 4, text('{"a":{"geometry":', pt, '},"b":{"geojson":', ln, '},"c":3}'))
        .when(kind == 5, text('{"features":[],"data":[{"geometry":null},{"geometry":{"type":"Circle"}}]}'))
        .when(kind == 6, text('{"geometry":', pt, ',"properties":{"c":null},"data":[1]}'))
        .otherwise(text('{"features":null,"records":[{"geometry":', pt, '}]}')))
    df = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), doc.alias("json"))
    out = loose_json.normalize_json_features(df, keep=("k",))
    return out.select("k", "position", "properties", F.expr(X.to_wkt("geom")).alias("wkt"))


# ---------------------------------------------------------------- indexes

def _index(spark, sf, df=None, **options):
    path = scratch_path(spark, "index")
    I.build_index(D.points(spark, sf) if df is None else df, path, **options)
    return path


@query("read_index", f"WITH {D.POINTS} SELECT fid, o_orderstatus, o_totalprice, x, y FROM points")
def read_index(spark, sf):
    rows = readers.read_dataset(spark, _index(spark, sf, parts=16), {"iformat": "rtree"})
    return rows.select("fid", "o_orderstatus", "o_totalprice", F.col("xmin").alias("x"), F.col("ymin").alias("y"))


@query("read_master", f"""WITH {D.POINTS}, placed AS (
  SELECT *, CAST(floor((y + 90) / 180.0 * 4) * 4 + floor((x + 180) / 360.0 * 4) AS INTEGER) AS part_id FROM points)
SELECT part_id, count(*) AS record_count, count(*) AS nonempty_count, count(*) AS num_points,
  CAST(sum(16 + length(CAST(fid AS VARCHAR)) + length(o_orderstatus) + length(CAST(o_totalprice AS VARCHAR)) + length(o_orderpriority)) AS BIGINT) AS data_size,
  'POLYGON((' || min(x) || ' ' || min(y) || ',' || max(x) || ' ' || min(y) || ',' || max(x) || ' ' || max(y) || ',' || min(x) || ' ' || max(y)
  || ',' || min(x) || ' ' || min(y) || '))' AS boundary FROM placed GROUP BY part_id""")
def read_master(spark, sf):
    path = _index(spark, sf, method="grid", parts=16, extent=(-180.0, -90.0, 180.0, 90.0))
    return I.read_master(spark, path).select("part_id", "record_count", "nonempty_count", "num_points", "data_size", "boundary")


@query("indexed_range_query", f"""WITH {D.POINTS} SELECT fid, x, y FROM points
WHERE (x >= 169.995 OR x <= -159.995) AND y BETWEEN -30.005 AND 30.005""")
def indexed_range_query(spark, sf):
    path = _index(spark, sf, parts=16)
    found = Q.indexed_range_query(I.read_index(spark, path), I.read_master(spark, path), "169.995,-30.005,200.005,30.005", points=True)
    return found.select("fid", F.col("xmin").alias("x"), F.col("ymin").alias("y"))


@query("break_and_index", f"""WITH {D.TRIPS}, n AS (SELECT fid, count(*) AS n FROM trip_vertices GROUP BY fid)
SELECT CAST(sum(CASE WHEN n <= 20 THEN 1 ELSE (n - 2) // 19 + 1 END) AS BIGINT) AS n_pieces, CAST(sum(CASE WHEN n <= 20 THEN n ELSE n + (n - 2) // 19 END) AS BIGINT) AS n_points FROM n""")
def break_and_index(spark, sf):
    path = scratch_path(spark, "broken")
    I.break_and_index(D.trips(spark, sf), path, threshold=20, parts=8)
    return I.read_master(spark, path).agg(F.sum("record_count").alias("n_pieces"), F.sum("num_points").alias("n_points"))


@query("build_indexes", f"""WITH {D.TRIPS}, n AS (SELECT fid, count(*) AS n FROM trip_vertices GROUP BY fid)
SELECT 'data' AS kind, count(*) AS n_records FROM n
UNION ALL SELECT 'viz', CAST(sum(CASE WHEN n <= 20 THEN 1 ELSE (n - 2) // 19 + 1 END) AS BIGINT) FROM n""")
def build_indexes(spark, sf):
    """Trips have 64 points, above the threshold of 20: a second index for drawing."""
    path = scratch_path(spark, "both")
    trips = D.trips(spark, sf)
    per = A.summarize(trips, key="fid").select(C.needs_separate_index(F.col("num_points"), F.col("num_features"), threshold=20)).first()[0]
    I.build_indexes(trips, path, per, 20, parts=8)
    data, viz = [I.read_master(spark, f"{path}/{k}_index") for k in ("data", "viz")]
    return data.agg(F.lit("data").alias("kind"), F.sum("record_count").alias("n_records")).unionByName(
        viz.agg(F.lit("viz").alias("kind"), F.sum("record_count").alias("n_records")))


# ---------------------------------------------------------------- exports and whole jobs

@query("export_csv_gz", f"""WITH {D.POINTS} SELECT x || ';' || y || ';' || fid || ';' || o_orderpriority AS value FROM points""")
def export_csv_gz(spark, sf):
    path = scratch_path(spark, "export")
    S.write_features(D.points(spark, sf).select("fid", "o_orderpriority", "geom"), path, "CSV.gz", points=True, sep=";")
    return spark.read.text(path)


@query("export_kml", f"""WITH {D.POINTS} SELECT '<Placemark><ExtendedData><Data name="fid"><value>' || fid || '</value></Data></ExtendedData><Point><coordinates>'
  || x || ',' || y || '</coordinates></Point></Placemark>' AS value FROM points
UNION ALL SELECT '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
UNION ALL SELECT '</Document></kml>'""")
def export_kml(spark, sf):
    path = scratch_path(spark, "export")
    S.write_features(D.points(spark, sf).select("fid", "geom"), path, "kmz")
    return spark.read.text(path).select("value")


@query("download_region", f"""WITH {D.POINTS}, {D.REGIONS}
SELECT '{{"fid":' || fid || ',"wkt":"POINT(' || x || ' ' || y || ')"}}' AS value FROM points JOIN regions ON code = 'NATION_8' AND {D.IN_REGION}""")
def download_region(spark, sf):
    index = _index(spark, sf, D.points(spark, sf).select("fid", "geom", *G.MBR_COLUMNS), parts=16)
    path = scratch_path(spark, "download")
    W.download(spark, index, path, "json.gz", regions=D.regions(spark, sf), region="NATION_8", order="position", points=True, bounded=True)
    return spark.read.text(path)


@query("download_box_lines", f"""WITH {D.LINES}, v AS (SELECT fid, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM line_vertices GROUP BY fid, label)
SELECT fid, label, n AS n_points FROM v WHERE x0 >= -45 AND x1 <= 45 AND y0 >= -20 AND y1 <= 20""")
def download_box_lines(spark, sf):
    """Lines within the box from an index (all that meet it, then those wholly inside)."""
    index = _index(spark, sf, D.lines(spark, sf), parts=8)
    rows = W.select_features(spark, index, mbr="-45,-20,45,20", key="fid")
    inside = G.with_mbr(rows).where("xmin >= -45 and xmax <= 45 and ymin >= -20 and ymax <= 20")
    return inside.select("fid", "label", F.expr(G.num_points("geom")).alias("n_points"))


@query("ingest_dataset", f"""WITH {D.POINTS}
SELECT 'ready' AS status, count(*) AS num_features, 'Point' AS geometry_type, min(x) AS xmin, max(y) AS ymax,
       CASE WHEN sum(16 + length(CAST(fid AS VARCHAR)) + length(o_orderpriority)) < 1048576 THEN 'Vector' ELSE 'Tile' END AS visualization FROM points""")
def ingest_dataset(spark, sf):
    """A submitted CSV of all points through every stage."""
    base = scratch_path(spark, "archive")
    D.points(spark, sf).select("xmin", "ymin", "fid", "o_orderpriority").write.csv(f"{base}/orders/points/download")
    table = C.CatalogTable(spark, f"{base}/catalog")
    form = spark.createDataFrame([("orders/points", "csv", {"iformat": "point(0,1)"}, "created")],
                                 "name string, format string, options map<string,string>, status string")
    table.insert(form)
    new = C.find_by_name(table.read(), "orders/points").first()["_id"]
    N.process_dataset(table, new, N.Run(base, threshold=DEFAULT_THRESHOLD))
    return C.find(table.read(), new).select(
        "status", "num_features", "geometry_type", F.get("extent", F.lit(0)).alias("xmin"),
        F.get("extent", F.lit(3)).alias("ymax"), F.col("visualization")["type"].alias("visualization"))


@query("region_download_lines", f"""WITH {D.TRIPS}
SELECT count(DISTINCT fid) AS n_trips FROM trip_vertices""")
def region_download_lines(spark, sf):
    """Every trip meets some of 25 bands that cover the world; each is counted once."""
    y0 = "n_nationkey * 7.2D - 90D"
    bands = D.table(spark, sf, "nation").selectExpr("'all' AS code", f"{G.box_polygon(-180, y0, 180, y0 + ' + 7.2D')} AS geom")
    one = bands.groupBy("code").agg(F.flatten(F.collect_list("geom.parts")).alias("parts"))
    world = one.selectExpr("code", f"{G.geometry(repr('MultiPolygon'), 'parts')} AS geom")
    return R.join_regions(D.trips(spark, sf), world).agg(F.count("*").alias("n_trips"))


@query("ingest_trips", f"""WITH {D.TRIPS}, n AS (SELECT fid, count(*) AS n FROM trip_vertices GROUP BY fid)
SELECT 'ready' AS status, count(*) AS num_features, CAST(sum(n) AS BIGINT) AS num_points, 'LineString' AS geometry_type,
  CAST(sum(CASE WHEN n <= 20 THEN 1 ELSE (n - 2) // 19 + 1 END) AS BIGINT) AS viz_records FROM n""")
def ingest_trips(spark, sf):
    """Lines above the threshold: a second index for drawing and tile counts from it."""
    base = scratch_path(spark, "archive")
    D.trips(spark, sf).select(F.expr(X.to_wkt("geom")).alias("w"), "fid").write.csv(f"{base}/trips/download", sep="\t")
    table = C.CatalogTable(spark, f"{base}/catalog")
    table.insert(spark.createDataFrame([("trips", "csv", {"iformat": "wkt(0)", "separator": "\t"}, "created")],
                                       "name string, format string, options map<string,string>, status string"))
    new = C.find_by_name(table.read(), "trips").first()["_id"]
    N.process_dataset(table, new, N.Run(base, threshold=20, levels=6))
    viz = I.read_master(spark, f"{base}/trips/viz_index").agg(F.sum("record_count").alias("viz_records"), F.lit("trips").alias("name"))
    row = C.find(table.read(), new).select("name", "status", "num_features", "num_points", "geometry_type")
    return row.join(viz, "name").drop("name")


@query("reindex", f"""WITH {D.POINTS} SELECT 'indexed' AS status, count(*) AS n, count(DISTINCT fid) AS n_distinct FROM points""")
def reindex(spark, sf):
    base = scratch_path(spark, "archive")
    D.points(spark, sf).select("xmin", "ymin", "fid").write.csv(f"{base}/p/download")
    table = C.CatalogTable(spark, f"{base}/catalog")
    table.insert(spark.createDataFrame([("p", {"iformat": "point(0,1)"}, "ready")], "name string, options map<string,string>, status string"))
    new = C.find_by_name(table.read(), "p").first()["_id"]
    N.reindex(table, new, N.Run(base, method="zcurve"))
    rows = I.read_index(spark, f"{base}/p/data_index")
    return rows.agg(F.lit(C.find(table.read(), new).first()["status"]).alias("status"), F.count("*").alias("n"),
                    F.count_distinct("_c2").alias("n_distinct"))


@query("catalog_table_changes", f"""WITH {D.CATALOG}
SELECT name, CASE WHEN doc_id % 7 = 0 THEN 'downloaded' ELSE status END AS status, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE title END AS title
FROM catalog WHERE doc_id <> 11""")
def catalog_table_changes(spark, sf):
    """Insert all rows, change some, delete one, and move a status, each as a new version."""
    table = C.CatalogTable(spark, scratch_path(spark, "catalog"))
    table.insert(D.catalog(spark, sf).drop("_id", "modifiedAt", "description"))
    number = F.split_part("name", F.lit("/"), F.lit(2)).cast("long")
    rows = table.read()
    table.update(rows.where(number % 5 == 0).select("_id", F.lit("changed").alias("title")))
    table.delete(rows.where(number == 11).first()["_id"])
    table.update_status_many("created", "downloaded")
    return table.read().select("name", "status", "title")


@query("read_text_master", f"""WITH {D.POINTS}, placed AS (
  SELECT *, CAST(floor((y + 90) / 180.0 * 8) * 8 + floor((x + 180) / 360.0 * 8) AS INTEGER) AS part_id FROM points)
SELECT part_id, 'part-' || part_id AS file_name, count(*) AS record_count, min(x) AS xmin, max(y) AS ymax FROM placed GROUP BY part_id""")
def read_text_master(spark, sf):
    """A manifest in the tab-separated layout, under a name that Spark would skip."""
    placed = P.spatial_partition(D.points(spark, sf).select("fid", "geom", *G.MBR_COLUMNS), "grid", parts=64, extent=P.WORLD)
    m = A.partition_stats(placed)
    path = scratch_path(spark, "text") + "/_master.cells"
    m.selectExpr("part_id AS ID", "concat('part-', part_id) AS `File Name`", "record_count", "nonempty_count", "num_points", "data_size",
                 "sum_x", "sum_y", "boundary", "xmin", "ymin", "xmax", "ymax").write.csv(path, sep="\t", header=True)
    return I.read_text_master(spark, path).select("part_id", "file_name", "record_count", "xmin", "ymax")


@query("expand_archives", f"""WITH {D.EVENT_POINTS}, f AS (SELECT event_id // 64 AS fid, string_agg(x || ',' || y || chr(10), '' ORDER BY event_id) AS t
  FROM event_points GROUP BY 1)
SELECT 'a' || fid // 16 || '/trips/' || fid || '.csv' AS file, length(t) AS n_bytes FROM f""")
def expand_archives(spark, sf):
    """Zip files unpacked in place by the tasks; the archives are gone afterwards."""
    path = scratch_path(spark, "unpack")
    _write_zips(_trip_texts(spark, sf), path)
    files = archives.expand_archives(spark, path)
    return files.select(F.regexp_extract("file", "(a[0-9]+/trips/[0-9]+[.]csv)$", 1).alias("file"), F.col("bytes").alias("n_bytes"))


_POINTS_EACH = f"WITH {D.POINTS} SELECT CAST(fid AS VARCHAR) AS fid, x, y FROM points"


def _read_exported(spark, sf, fmt, key=None):
    """Points written by the export and read by the public reader."""
    path = scratch_path(spark, "geojson")
    S.write_features(D.points(spark, sf).select("fid", "geom"), path, fmt, key=key)
    df = readers.read_dataset(spark, path, {"iformat": "geojson"})
    return df.select(F.col("properties")["fid"].alias("fid"), *_xy(df))


@query("geojson_round_trip_lines", _POINTS_EACH)
def geojson_round_trip_lines(spark, sf):
    return _read_exported(spark, sf, "geojson")


@query("geojson_round_trip_gz", _POINTS_EACH)
def geojson_round_trip_gz(spark, sf):
    return _read_exported(spark, sf, "geojson.gz")


@query("geojson_round_trip_document", _POINTS_EACH)
def geojson_round_trip_document(spark, sf):
    """One collection over many part files."""
    return _read_exported(spark, sf, "geojson", "fid")


@query("rsgrove_many_parts", f"WITH {D.POINTS} SELECT count(*) AS n, TRUE AS named, TRUE AS balanced FROM points")
def rsgrove_many_parts(spark, sf):
    """More partitions than one sample on the driver is cut into: all points are placed, and no partition holds far more than its share."""
    parts = 3000
    placed = P.spatial_partition(D.points(spark, sf), parts=parts, balanced=False)
    sizes = placed.groupBy("part_id").agg(F.count("*").alias("rows"))
    return sizes.agg(F.sum("rows").alias("n"), (F.count("*") > F.least(F.lit(parts), F.sum("rows")) / 4).alias("named"),
                     (F.max("rows") <= 12 * F.sum("rows") / F.least(F.lit(parts), F.sum("rows")) + 12).alias("balanced"))


_ARCHIVE = f"""WITH {D.POINTS_BIG}, named AS (
  SELECT CASE WHEN l_quantity <= 25 THEN 'half' ELSE 'd' || CAST(l_quantity AS INTEGER) END AS dataset_id, x, y, l_returnflag FROM points_big)"""


@query("archive_index", f"""{_ARCHIVE}
SELECT dataset_id, count(*) AS n, sum(16 + length(dataset_id) + length(l_returnflag)) AS bytes, min(x) AS xmin, max(y) AS ymax, TRUE AS balanced, TRUE AS numbered
FROM named GROUP BY dataset_id""")
def archive_index(spark, sf):
    """All datasets partitioned and written in one job; one of them holds half of the rows."""
    target = 4096
    points = D.points_big(spark, sf).selectExpr("if(l_quantity <= 25, 'half', concat('d', int(l_quantity))) AS dataset_id", "l_returnflag", "geom", *G.MBR_COLUMNS)
    path = f"{scratch_path(spark, 'archive')}/index"
    V.build_archive_index(points, path, target_size=target)
    master = I.read_master(spark, path)
    by_dataset = master.groupBy("dataset_id").agg(
        F.sum("record_count").alias("n"), F.sum("data_size").alias("bytes"), F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax"),
        F.max("data_size").alias("largest"), F.count("*").alias("parts"), F.max("part_id").alias("last"))
    share = F.col("bytes") / F.ceil(F.col("bytes") / target)
    return by_dataset.select("dataset_id", "n", "bytes", "xmin", "ymax", (F.col("largest") <= 2 * share + 64).alias("balanced"), (F.col("last") + 1 == F.col("parts")).alias("numbered"))


@query("download_by_name", f"""WITH {D.POINTS} SELECT CAST(fid AS VARCHAR) AS fid, x, y FROM points WHERE x BETWEEN -20 AND 30 AND y BETWEEN -10 AND 40""")
def download_by_name(spark, sf):
    """Index, geometry and separator from the catalog row."""
    base = scratch_path(spark, "archive")
    I.build_index(D.points(spark, sf).select("fid", "geom", *G.MBR_COLUMNS), f"{base}/orders/points/data_index", parts=16)
    catalog = spark.createDataFrame([("1", "orders/points", "orders/points/data_index", "Point", {"separator": ";"})],
                                    "_id string, name string, index_path string, geometry_type string, options map<string,string>")
    path = scratch_path(spark, "download")
    W.download_by_name(spark, catalog, base, "orders/points", path, "csv.gz", mbr="-20,-10,30,40")
    back = spark.read.csv(path, sep=";")
    return back.selectExpr("_c2 AS fid", "double(_c0) AS x", "double(_c1) AS y")


@query("view_indexed", f"""WITH {D.POINTS}, p AS (SELECT *, CAST(floor((y + 90) / 180.0 * 4) * 4 + floor((x + 180) / 360.0 * 4) AS INTEGER) AS part FROM points), hit AS (
  SELECT * FROM p WHERE (x >= 170 OR x <= -170) AND y BETWEEN -40 AND 60 ORDER BY CASE WHEN x >= 170 THEN 0 ELSE 1 END, part, fid LIMIT 1)
SELECT '{{"o_orderpriority":"' || o_orderpriority || '"}}' AS record FROM hit""")
def view_indexed(spark, sf):
    """First record by box, partition and key; partitions away from both boxes are not read."""
    path = scratch_path(spark, "index")
    placed = P.spatial_partition(D.points(spark, sf).select("fid", "o_orderpriority", "geom", *G.MBR_COLUMNS), "grid", parts=16, extent=P.WORLD)
    I.save_index(placed, path)
    return W.view_indexed(spark, path, ["fid"], "170,-40,190,60")


@query("is_current", f"WITH {D.POINTS} SELECT count(*) AS n, TRUE AS later, FALSE AS earlier FROM points")
def is_current(spark, sf):
    """A copy made after the index is current, one made before it is not."""
    path = _index(spark, sf, D.points(spark, sf).select("fid", "geom", *G.MBR_COLUMNS), parts=4)
    later = W.is_current(spark, path, F.current_timestamp() + F.expr("interval 1 day")).select(F.col("unchanged").alias("later"))
    earlier = W.is_current(spark, path, F.lit("2001-01-01").cast("timestamp")).select(F.col("unchanged").alias("earlier"))
    return I.read_index(spark, path).agg(F.count("*").alias("n")).withColumns({"later": later.scalar(), "earlier": earlier.scalar()})


@query("ingest_tiles", f"""WITH {D.POINTS}, merc AS (
  SELECT (x + 180) / 360 AS u, (1 - ln(tan(y * (pi() / 180)) + 1 / cos(y * (pi() / 180))) / pi()) / 2 AS v FROM points
  WHERE y BETWEEN -85.0511287798066 AND 85.0511287798066)
SELECT CAST(z AS INTEGER) AS z, CAST(greatest(0, least((1 << CAST(z AS INTEGER)) - 1, floor(u * (1 << CAST(z AS INTEGER))))) AS BIGINT) AS x,
       CAST(greatest(0, least((1 << CAST(z AS INTEGER)) - 1, floor(v * (1 << CAST(z AS INTEGER))))) AS BIGINT) AS y, count(*) AS cnt
FROM merc, range(20) r(z) GROUP BY ALL""")
def ingest_tiles(spark, sf):
    """The pyramid that a dataset gets when its bytes reach the limit, all 20 levels of it."""
    base = scratch_path(spark, "archive")
    D.points(spark, sf).select("xmin", "ymin", "fid").write.csv(f"{base}/p/download")
    table = C.CatalogTable(spark, f"{base}/catalog")
    table.insert(spark.createDataFrame([("p", {"iformat": "point(0,1)"}, "created")], "name string, options map<string,string>, status string"))
    N.process_dataset(table, C.find_by_name(table.read(), "p").first()["_id"], N.Run(base, vector_limit=0))
    tiles = spark.read.parquet(f"{base}/p/plot")
    return tiles.selectExpr("int(z) AS z", "bigint(x) AS x", "bigint(y) AS y", "cnt")


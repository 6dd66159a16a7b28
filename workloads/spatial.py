"""Queries over features: regions, boxes, summaries, breaking, partitions, tiles, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions import textgeom as X
from mapshelf.functions.cover import point_cells, point_in_piece, region_cover
from mapshelf.functions.grid import world_column, world_row
from mapshelf.operators import boxes as B
from mapshelf.operators import breaking as K
from mapshelf.operators import partitioning as P
from mapshelf.operators import regions as R
from mapshelf.operators import spatial_filter as Q
from mapshelf.operators import summary as A
from mapshelf.operators import tiles as V
from mapshelf.session import materialize, scratch_path
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


# ---------------------------------------------------------------- regions

@query("region_counts", f"""WITH {D.POINTS}, {D.REGIONS}
SELECT code, count(x) AS n_features FROM regions LEFT JOIN points ON {D.IN_REGION} GROUP BY code""")
def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.region_counts(D.points(spark, sf), D.regions(spark, sf).select("code", "geom"), points=True)


@query("region_counts_big", f"""WITH {D.POINTS_BIG}, {D.REGIONS}
SELECT code, count(x) AS n_features FROM regions LEFT JOIN points_big ON {D.IN_REGION} GROUP BY code""")
def region_counts_big(spark, sf):
    return R.region_counts(D.points_big(spark, sf), D.regions(spark, sf).select("code", "geom"), "l_returnflag", True)


@query("region_subset", f"""WITH {D.POINTS}, {D.REGIONS}
SELECT fid, o_orderstatus, o_totalprice, x, y FROM points JOIN regions ON code = 'NATION_7' AND {D.IN_REGION}""")
def region_subset(spark, sf):
    found = R.region_query(D.points(spark, sf), D.regions(spark, sf), "NATION_7", order="position", points=True)
    return found.select("fid", "o_orderstatus", "o_totalprice", F.col("xmin").alias("x"), F.col("ymin").alias("y"))


# A line meets a rectangle if the part of some edge within the box is not empty, and a diamond
# if it does so in coordinates turned by 45 degrees, where the diamond is a square.
_CLIP = """
  greatest(CAST(0 AS DOUBLE),
           CASE WHEN du > 0 THEN (lo_u - u1) / du WHEN du < 0 THEN (hi_u - u1) / du WHEN u1 BETWEEN lo_u AND hi_u THEN 0 ELSE 2 END,
           CASE WHEN dv > 0 THEN (lo_v - v1) / dv WHEN dv < 0 THEN (hi_v - v1) / dv WHEN v1 BETWEEN lo_v AND hi_v THEN 0 ELSE 2 END)
  <= least(CAST(1 AS DOUBLE),
           CASE WHEN du > 0 THEN (hi_u - u1) / du WHEN du < 0 THEN (lo_u - u1) / du ELSE 1 END,
           CASE WHEN dv > 0 THEN (hi_v - v1) / dv WHEN dv < 0 THEN (lo_v - v1) / dv ELSE 1 END)"""

_EDGES = D.LINES + """,
line_edges AS (
  SELECT a.fid, a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM line_vertices a JOIN line_vertices b ON a.fid = b.fid AND b.i = a.i + 1)"""


@query("region_join_lines", f"""WITH {_EDGES}, {D.REGIONS}, both_ AS (
  SELECT fid, code,
    CASE WHEN position % 2 = 0 THEN x1 - cx ELSE (x1 - cx) + (y1 - cy) END AS u1,
    CASE WHEN position % 2 = 0 THEN y1 - cy ELSE (x1 - cx) - (y1 - cy) END AS v1,
    CASE WHEN position % 2 = 0 THEN x2 - cx ELSE (x2 - cx) + (y2 - cy) END AS u2,
    CASE WHEN position % 2 = 0 THEN y2 - cy ELSE (x2 - cx) - (y2 - cy) END AS v2,
    CASE WHEN position % 2 = 0 THEN 25.0 ELSE 20.005 END::DOUBLE AS hi_u,
    CASE WHEN position % 2 = 0 THEN 10.0 ELSE 20.005 END::DOUBLE AS hi_v
  FROM line_edges, regions), moved AS (
  SELECT *, -hi_u AS lo_u, -hi_v AS lo_v, u2 - u1 AS du, v2 - v1 AS dv FROM both_)
SELECT DISTINCT fid, code FROM moved WHERE {_CLIP}""")
def region_join_lines(spark, sf):
    return R.join_regions(D.lines(spark, sf), D.regions(spark, sf).select("code", "geom"))


@query("region_cover", f"""WITH {D.POINTS}, {D.REGIONS}
SELECT code, count(*) AS n_points FROM regions, points WHERE {D.IN_REGION} GROUP BY code""")
def region_cover_query(spark, sf):
    """Points counted through the cover: inside rows as a whole, the others by their edges."""
    cover = materialize(region_cover(D.regions(spark, sf).select("code", "geom")), "cover")
    p = D.points(spark, sf).selectExpr("xmin AS x", "ymin AS y", f"{world_column('xmin')} AS fx", f"{world_row('ymin')} AS fy")
    on = f"f_level = level AND f_cell = cell AND fx BETWEEN ix0 AND ix1 AND fy BETWEEN iy0 AND iy1 AND {point_in_piece('x', 'y')}"
    return point_cells(p, cover).join(cover, F.expr(on)).groupBy("code").agg(F.count("*").alias("n_points"))


@query("region_join_dense", f"""WITH {D.PARCELS}, {D.PARCEL_POINTS}
SELECT fid, line, code FROM parcel_points JOIN parcels USING (gx, gy) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def region_join_dense(spark, sf):
    """As many small regions as there are orders, all within one base cell."""
    found = R.join_regions(D.parcel_points(spark, sf).withColumn("key", F.struct("fid", "line")), D.parcels(spark, sf), "key", points=True)
    return found.select("key.fid", "key.line", "code")


@query("region_join_dense_lines", f"""WITH {D.PARCELS}, {D.PARCEL_POINTS}, crossed AS (
  SELECT p.fid, p.line, r.code FROM parcel_points p, unnest([0, 1, 2, 3]) AS u(i), parcels r
  WHERE r.gx = p.gx + i AND r.gy = p.gy AND p.y BETWEEN r.y0 AND r.y1 AND p.x <= r.x1 AND p.x + CAST(0.03 AS DOUBLE) >= r.x0)
SELECT fid, line, code FROM crossed""")
def region_join_dense_lines(spark, sf):
    """Level lines of three cells' length that start at these points."""
    lines = D.parcel_points(spark, sf).selectExpr("struct(fid, line) AS key", f"{G.line('array(' + G.vertex('xmin', 'ymin') + ', ' + G.vertex('xmin + 0.03D', 'ymin') + ')')} AS geom")
    return R.join_regions(lines, D.parcels(spark, sf), "key").select("key.fid", "key.line", "code")


@query("region_list", f"""WITH {D.REGIONS}
SELECT code, '{{"position":' || position || ',"display_name":"' || display_name || '","search_names":["' || code
       || '","' || r_name || '"]}}' AS properties FROM regions""")
def region_list(spark, sf):
    return R.region_list(D.regions(spark, sf))


@query("region_list_document", f"""WITH {D.REGIONS}, e AS (
SELECT code, '"' || code || '":{{"position":' || position || ',"display_name":"' || display_name || '","search_names":["' || code
       || '","' || r_name || '"]}}' AS line FROM regions)
SELECT CASE WHEN code = (SELECT min(code) FROM e) THEN 1 ELSE 2 END AS part,
  CASE WHEN code = (SELECT min(code) FROM e) THEN '' ELSE ',' END || line AS line FROM e
UNION ALL SELECT 0, '{{' UNION ALL SELECT 3, '}}'""")
def region_list_document(spark, sf):
    return R.region_list_document(D.regions(spark, sf)).select("part", "line")


@query("region_suggest", f"""WITH {D.REGIONS}
SELECT code, display_name AS display FROM regions
WHERE lower(code) LIKE '%asia%' OR lower(display_name) LIKE '%asia%' OR lower(r_name) LIKE '%asia%'
ORDER BY code LIMIT 10""")
def region_suggest(spark, sf):
    return R.region_suggest(D.regions(spark, sf), " ASIA")


@query("region_lookup", f"""WITH c AS (SELECT c_mktsegment AS code, max(c_custkey) AS k FROM customer GROUP BY 1)
SELECT code, c_name AS display_name FROM c JOIN customer ON c_custkey = k WHERE code = 'MACHINERY'""")
def region_lookup(spark, sf):
    """Many rows per code; the last one wins."""
    c = D.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("code"), F.col("c_name").alias("display_name"), F.col("c_custkey").alias("position"))
    return R.region_lookup(c, "MACHINERY", "position").select("code", "display_name")


# ---------------------------------------------------------------- boxes and range queries

_RANGE = "SELECT fid, x, y, o_orderstatus FROM points WHERE "


def _range(spark, sf, mbr):
    found = Q.range_query(D.points(spark, sf), mbr, points=True)
    return found.select("fid", F.col("xmin").alias("x"), F.col("ymin").alias("y"), "o_orderstatus")


@query("range_query_simple", f"WITH {D.POINTS} {_RANGE} x BETWEEN -20.005 AND 30.005 AND y BETWEEN -10.005 AND 40.005")
def range_query_simple(spark, sf):
    return _range(spark, sf, "-20.005,-10.005,30.005,40.005")


@query("range_query_dateline", f"""WITH {D.POINTS} {_RANGE} (x >= 170 - 0.005 OR x <= 200 - 360 + 0.005)
  AND y BETWEEN -30.005 AND 30.005""")
def range_query_dateline(spark, sf):
    return _range(spark, sf, "169.995,-30.005,200.005,30.005")


@query("range_query_world", f"WITH {D.POINTS} {_RANGE} y BETWEEN -45.005 AND 45.005")
def range_query_world(spark, sf):
    return _range(spark, sf, "-200,-45.005,250,45.005")


@query("range_query_edges", f"WITH {D.POINTS} {_RANGE} x BETWEEN -20 AND 40 AND y BETWEEN -10 AND 40")
def range_query_edges(spark, sf):
    """Whole-number edges, so that many points lie on the border of the box."""
    f = D.points(spark, sf)
    whole = f.select("fid", "o_orderstatus", "geom", *G.MBR_COLUMNS)
    found = Q.range_query(whole, (-20, -10, 40, 40))
    return found.select("fid", F.col("xmin").alias("x"), F.col("ymin").alias("y"), "o_orderstatus")


@query("range_query_lines", f"""WITH {_EDGES}, moved AS (
  SELECT fid, label, x1 AS u1, y1 AS v1, x2 - x1 AS du, y2 - y1 AS dv,
         CAST(20 AS DOUBLE) AS lo_u, CAST(30 AS DOUBLE) AS hi_u, CAST(-12 AS DOUBLE) AS lo_v, CAST(-8 AS DOUBLE) AS hi_v
  FROM line_edges)
SELECT DISTINCT fid, label FROM moved WHERE {_CLIP}""")
def range_query_lines(spark, sf):
    return Q.range_query(D.lines(spark, sf), (20, -12, 30, -8)).select("fid", "label")


_BOXES = """boxes AS (
  SELECT c_custkey AS k, (c_custkey * 37) % 1000 - 500 AS w, (c_custkey * 13) % 80 - 80 AS s,
         (c_custkey * 37) % 1000 - 500 + (c_custkey * 7) % 400 AS e, (c_custkey * 13) % 80 AS n FROM customer)"""


@query("normalize_boxes", f"""WITH {_BOXES}, wrapped AS (
  SELECT k, CAST(s AS DOUBLE) AS ymin, CAST(n AS DOUBLE) AS ymax,
    CASE WHEN e - w >= 360 THEN -180.0 ELSE w - 360 * floor((w + 180) / 360.0) END AS x0,
    CASE WHEN e - w >= 360 THEN 180.0 ELSE e - 360 * floor((e + 180) / 360.0) END AS x1 FROM boxes)
SELECT k, 0 AS box_no, CAST(x0 AS DOUBLE) AS xmin, ymin, CAST(CASE WHEN x0 > x1 THEN 180 ELSE x1 END AS DOUBLE) AS xmax, ymax FROM wrapped
UNION ALL SELECT k, 1, CAST(-180 AS DOUBLE), ymin, CAST(x1 AS DOUBLE), ymax FROM wrapped WHERE x0 > x1""")
def normalize_boxes(spark, sf):
    k = F.col("c_custkey")
    w, s = (k * 37) % 1000 - 500, (k * 13) % 80 - 80
    e, n = w + (k * 7) % 400, (k * 13) % 80
    text = F.concat_ws(",", *[v.cast("string") for v in (w, s, e, n)])
    df = D.table(spark, sf, "customer").select(k.alias("k"), B.parse_mbr(text).alias("box"))
    return df.select("k", F.posexplode(B.normalize_mbr(F.col("box"))).alias("box_no", "b")).select("k", "box_no", "b.*")


@query("view_feature", f"""WITH {D.POINTS}, hit AS (
  SELECT * FROM points WHERE (x >= 175 OR x <= -170) AND y BETWEEN 10 AND 60
  ORDER BY CASE WHEN x >= 175 THEN 0 ELSE 1 END, fid LIMIT 1)
SELECT '{{"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || ',"o_orderpriority":"'
       || o_orderpriority || '","extents":[' || x || ',' || y || ',' || x || ',' || y || ']}}' AS record FROM hit""")
def view_feature(spark, sf):
    return Q.view_feature(D.points(spark, sf), ["fid"], "175,10,190,60", extents=True)


@query("view_feature_geojson", f"""WITH {D.POINTS}
SELECT '{{"type":"Feature","properties":{{"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice
       || ',"o_orderpriority":"' || o_orderpriority || '"}},"geometry":{{"type":"Point","coordinates":[' || x || ',' || y || ']}}}}' AS record
FROM points ORDER BY fid LIMIT 1""")
def view_feature_geojson(spark, sf):
    return Q.view_feature(D.points(spark, sf), ["fid"], fmt="geojson")


@query("view_feature_none", f"""WITH {D.POINTS}
SELECT '{{"out_bound":1}}' AS record FROM (SELECT count(*) AS n FROM points WHERE y > 86) WHERE n = 0""")
def view_feature_none(spark, sf):
    return Q.view_feature(D.points(spark, sf), ["fid"], "0,86,10,89")


# ---------------------------------------------------------------- summaries

@query("summary_points", f"""WITH {D.POINTS}
SELECT CAST(sum(16 + length(o_orderstatus) + length(CAST(o_totalprice AS VARCHAR)) + length(o_orderpriority)) AS BIGINT) AS size,
       count(*) AS num_features, CAST(NULL AS BIGINT) AS num_points, 'Point' AS geometry_type,
       min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, true AS no_sides FROM points""")
def summary_points(spark, sf):
    s = A.summarize(D.points(spark, sf), key="fid")
    return s.select("size", "num_features", "num_points", "geometry_type", *[
        F.get("extent", F.lit(i)).alias(c) for i, c in enumerate(G.MBR_COLUMNS)],
        F.col("avg_sidelength").isNull().alias("no_sides"))


@query("summary_by_user", f"""WITH {D.EVENT_POINTS}
SELECT user_id, CAST(sum(16 + length(event_type)) AS BIGINT) AS size, count(*) AS num_features,
       min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM event_points GROUP BY user_id""")
def summary_by_user(spark, sf):
    s = A.summarize(D.event_points(spark, sf), by=["user_id"], key="event_id")
    return s.select("user_id", "size", "num_features", *[
        F.get("extent", F.lit(i)).alias(c) for i, c in enumerate(G.MBR_COLUMNS)])


@query("summary_trips", f"""WITH {D.TRIPS}, t AS (
  SELECT fid, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM trip_vertices GROUP BY fid)
SELECT CAST(16 * sum(n) AS BIGINT) AS size, count(*) AS num_features, CAST(sum(n) AS BIGINT) AS num_points, 'LineString' AS geometry_type,
       round(avg(x1 - x0), 6) AS width, round(avg(y1 - y0), 6) AS height FROM t""")
def summary_trips(spark, sf):
    s = A.summarize(D.trips(spark, sf), key="fid")
    return s.select("size", "num_features", "num_points", "geometry_type",
                    F.round(F.get("avg_sidelength", F.lit(0)), 6).alias("width"),
                    F.round(F.get("avg_sidelength", F.lit(1)), 6).alias("height"))


@query("attribute_types", f"""WITH {D.POINTS}, f AS (SELECT * FROM points ORDER BY fid LIMIT 1)
SELECT 'fid' AS name, 'integer' AS type FROM f UNION ALL SELECT 'o_orderstatus', 'string' FROM f
UNION ALL SELECT 'o_totalprice', 'number' FROM f UNION ALL SELECT 'o_orderpriority', 'string' FROM f
UNION ALL SELECT 'gap', 'unknown' FROM f""")
def attribute_types(spark, sf):
    p = D.points(spark, sf).withColumn("gap", F.when(F.col("fid") > 0, F.lit("x")))
    return A.attribute_types(p, "fid")


@query("geometry_measures", f"""WITH {D.LINES}
SELECT fid, count(*) AS n_points, false AS empty, max(x) - min(x) AS width, max(y) - min(y) AS height,
       min(x) AS xmin, max(y) AS ymax FROM line_vertices GROUP BY fid""")
def geometry_measures(spark, sf):
    g = F.col("geom")
    return G.with_mbr(D.lines(spark, sf)).select(
        "fid", F.expr(G.num_points("geom")).alias("n_points"), F.expr(G.is_empty("geom")).alias("empty"), F.expr(G.side_lengths("geom") + ".width AS width"),
        F.expr(G.side_lengths("geom") + ".height AS height"), "xmin", "ymax")


# ---------------------------------------------------------------- breaking

def _broken_sql(source: str, table: str, t: int) -> str:
    return f"""WITH {source}, sized AS (SELECT *, count(*) OVER (PARTITION BY fid) AS n FROM {table}),
cut AS (SELECT fid, n, i, x, y, k FROM sized, range(64) c(k)
  WHERE CASE WHEN n <= {t} THEN k = 0 ELSE k <= (n - 2) // ({t} - 1) AND i BETWEEN k * ({t} - 1) AND k * ({t} - 1) + {t} - 1 END)
SELECT fid, CAST(k AS INTEGER) AS piece, count(*) AS n_points, min_by(x, i) AS first_x, min_by(y, i) AS first_y,
       max_by(x, i) AS last_x, max_by(y, i) AS last_y FROM cut GROUP BY fid, k"""


def _broken(df, t):
    b = K.break_geometries(df.select("fid", "geom"), t, position="piece")
    v = F.get(F.expr(G.rings_of("geom")), F.lit(0))
    return b.select("fid", "piece", F.expr(G.num_points("geom")).alias("n_points"), v.alias("v")).select(
        "fid", "piece", "n_points", F.get("v", F.lit(0))["x"].alias("first_x"), F.get("v", F.lit(0))["y"].alias("first_y"),
        F.element_at("v", -1)["x"].alias("last_x"), F.element_at("v", -1)["y"].alias("last_y"))


@query("break_trips", _broken_sql(D.TRIPS, "trip_vertices", 20))
def break_trips(spark, sf):
    return _broken(D.trips(spark, sf), 20)


@query("break_lines", _broken_sql(D.LINES, "line_vertices", 5))
def break_lines(spark, sf):
    return _broken(D.lines(spark, sf), 5)


@query("break_multipoints", f"""WITH {D.TRIPS}
SELECT fid, CAST(i AS INTEGER) AS piece, 'Point' AS kind, x, y FROM (SELECT *, count(*) OVER (PARTITION BY fid) AS n FROM trip_vertices)
WHERE n > 20""")
def break_multipoints(spark, sf):
    trips = D.trips(spark, sf, "MultiPoint").where(F.expr(G.num_points("geom")) > 20)
    b = K.break_geometries(trips, 20, position="piece")
    return b.select("fid", "piece", F.col("geom")["kind"].alias("kind"),
                    F.expr(G.xmin("geom")).alias("x"), F.expr(G.ymin("geom")).alias("y"))


@query("viz_features", f"""WITH {D.POINTS} SELECT count(*) AS n, min(x) AS xmin, max(y) AS ymax
FROM (SELECT x, CASE WHEN fid % 5 = 0 THEN y + 10 ELSE y END AS y, fid FROM points)
WHERE fid % 7 <> 0 AND y <= 85.0511287798066 AND y >= -85.0511287798066""")
def viz_features(spark, sf):
    """Every seventh geometry missing and every fifth moved north, some of them off the map."""
    y = "if(fid % 5 = 0, ymin + 10D, ymin)"
    moved = D.points(spark, sf).selectExpr("fid", f"if(fid % 7 <> 0, {G.point('xmin', y)}, null) AS geom")
    return K.viz_features(moved, 20).agg(
        F.count("*").alias("n"), F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax"))


# ---------------------------------------------------------------- partitions

def _parts(df: DataFrame) -> DataFrame:
    s = A.partition_stats(df.withColumn("n_bytes", F.lit(16)))
    return s.select("part_id", "record_count", "nonempty_count", "num_points",
                    F.round("sum_x", 3).alias("sum_x"), F.round("sum_y", 3).alias("sum_y"), *G.MBR_COLUMNS)


_PARTS_SQL = """SELECT part_id, count(*) AS record_count, count(*) AS nonempty_count, count(*) AS num_points,
  round(sum(x), 3) AS sum_x, round(sum(y), 3) AS sum_y, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
FROM placed GROUP BY part_id"""
_SMALL = "fid", "geom", *G.MBR_COLUMNS


@query("grid_partition", f"""WITH {D.POINTS}, placed AS (
  SELECT *, CAST(floor((y + 90) / 180.0 * 8) * 8 + floor((x + 180) / 360.0 * 8) AS INTEGER) AS part_id FROM points)
{_PARTS_SQL}""")
def grid_partition(spark, sf):
    return _parts(P.spatial_partition(D.points(spark, sf).select(*_SMALL), "grid", parts=64, extent=P.WORLD))


_BINS = """binned AS (SELECT *, CAST(floor((x + 180) / 360.0 * 1024) AS INTEGER) AS bx,
  CAST(floor((y + 90) / 180.0 * 1024) AS INTEGER) AS by_ FROM points)"""


@query("str_partition", f"""WITH {D.POINTS}, {_BINS},
xs AS (SELECT bx, count(*) AS w FROM binned GROUP BY bx),
slabs AS (SELECT bx, CAST((sum(w) OVER (ORDER BY bx) - w) * 8 // (SELECT sum(w) FROM xs) AS INTEGER) AS slab FROM xs),
ys AS (SELECT slab, by_, count(*) AS w FROM binned JOIN slabs USING (bx) GROUP BY slab, by_),
ts AS (SELECT slab, by_, CAST((sum(w) OVER (PARTITION BY slab ORDER BY by_) - w) * 8
         // (sum(w) OVER (PARTITION BY slab)) AS INTEGER) AS tile FROM ys),
placed AS (SELECT binned.*, slab * 8 + tile AS part_id FROM binned JOIN slabs USING (bx) JOIN ts USING (slab, by_))
{_PARTS_SQL}""")
def str_partition(spark, sf):
    return _parts(P.spatial_partition(D.points(spark, sf).select(*_SMALL), "str", parts=64, extent=P.WORLD))


_Z = " + ".join(f"(((bx >> {i}) & 1) << {2 * i}) + (((by_ >> {i}) & 1) << {2 * i + 1})" for i in range(10))


@query("zcurve_partition", f"""WITH {D.POINTS}, {_BINS},
zs AS (SELECT bx, by_, {_Z} AS z, count(*) AS w FROM binned GROUP BY bx, by_),
cum AS (SELECT bx, by_, CAST((sum(w) OVER (ORDER BY z) - w) * 64 // (SELECT sum(w) FROM zs) AS INTEGER) AS part_id FROM zs),
placed AS (SELECT binned.*, part_id FROM binned JOIN cum USING (bx, by_))
{_PARTS_SQL}""")
def zcurve_partition(spark, sf):
    return _parts(P.spatial_partition(D.points(spark, sf).select(*_SMALL), "zcurve", parts=64, extent=P.WORLD))


@query("rsgrove_partition", f"""WITH {D.POINTS}
SELECT count(*) AS n_features, count(DISTINCT fid) AS n_distinct, 32 AS n_parts, true AS balanced,
       CAST(sum(16 + length(o_orderstatus)) AS BIGINT) AS n_bytes FROM points""")
def rsgrove_partition(spark, sf):
    """Every feature in one part, and no part above twice the mean weight."""
    p = D.points(spark, sf).select("fid", "o_orderstatus", "geom", *G.MBR_COLUMNS)
    weight = A.feature_bytes(p, key="fid")
    placed = P.spatial_partition(p, "rsgrove", parts=32, weight=weight)
    each = placed.groupBy("part_id").agg(F.count("*").alias("n"), F.count_distinct("fid").alias("d"), F.sum(F.expr(weight)).alias("b"))
    return each.agg(F.sum("n").alias("n_features"), F.sum("d").alias("n_distinct"), F.count("*").cast("int").alias("n_parts"),
                    (F.max("b") <= 2 * F.avg("b")).alias("balanced"), F.sum("b").alias("n_bytes"))


@query("pruned_partitions", f"""WITH {D.POINTS}, placed AS (
  SELECT *, CAST(floor((y + 90) / 180.0 * 8) * 8 + floor((x + 180) / 360.0 * 8) AS INTEGER) AS part_id FROM points),
stats AS ({_PARTS_SQL})
SELECT part_id, record_count FROM stats WHERE (xmax >= 150 OR xmin <= -160) AND ymin <= 20 AND ymax >= -5""")
def pruned_partitions(spark, sf):
    placed = P.spatial_partition(D.points(spark, sf).select(*_SMALL), "grid", parts=64, extent=P.WORLD)
    master = A.partition_stats(placed.withColumn("n_bytes", F.lit(16)))
    return Q.prune_partitions(master, B.query_boxes("150,-5,200,20")).select("part_id", "record_count")


# ---------------------------------------------------------------- tiles

_MERC = """merc AS (SELECT fid, (x + 180) / 360 AS u,
  (1 - ln(tan(y * (pi() / 180)) + 1 / cos(y * (pi() / 180))) / pi()) / 2 AS v FROM points)"""
# Points further north or south than the map do not occur: |y| <= 85.


def _tile(value: str, z: str) -> str:
    return f"CAST(greatest(0, least((1 << {z}) - 1, floor({value} * (1 << {z})))) AS BIGINT)"


@query("to_mercator", f"WITH {D.POINTS}, {_MERC} SELECT fid, round(u, 9) AS u, round(v, 9) AS v FROM merc")
def to_mercator(spark, sf):
    m = D.points(spark, sf).select("fid", F.expr(V.to_mercator("geom")).alias("geom"))
    return m.select("fid", F.round(F.expr(G.xmin("geom")), 9).alias("u"), F.round(F.expr(G.ymin("geom")), 9).alias("v"))


@query("assign_tiles", f"""WITH {D.POINTS}, {_MERC}
SELECT fid, CAST(z AS INTEGER) AS z, {_tile('u', 'CAST(z AS INTEGER)')} AS x, {_tile('v', 'CAST(z AS INTEGER)')} AS y
FROM merc, range(10) r(z)""")
def assign_tiles(spark, sf):
    return V.assign_tiles(D.points(spark, sf), 10)


def _counts_sql(levels: int) -> str:
    return f"""WITH {D.POINTS}, {_MERC}
SELECT CAST(z AS INTEGER) AS z, {_tile('u', 'CAST(z AS INTEGER)')} AS x, {_tile('v', 'CAST(z AS INTEGER)')} AS y, count(*) AS cnt
FROM merc, range({levels}) r(z) GROUP BY 1, 2, 3"""


@query("tile_rollup", _counts_sql(20))
def tile_rollup(spark, sf):
    return V.tile_counts(D.points(spark, sf), 20, points=True)


@query("tile_counts", _counts_sql(20))
def tile_counts(spark, sf):
    """Points in a table that may have any shapes."""
    return V.tile_counts(D.points(spark, sf)).drop("inside")


def _mercator(x: str, y: str, i: str) -> str:
    """Place in the unit square; latitudes stop at the map's edge."""
    phi = f"greatest(CAST(-85.0511287798066 AS DOUBLE), least(CAST(85.0511287798066 AS DOUBLE), {y})) * (pi() / 180)"
    return f"({x} + 180) / 360 AS u{i}, (1 - ln(tan({phi}) + 1 / cos({phi})) / pi()) / 2 AS v{i}"


def _walked(edges: str, levels: str) -> str:
    """CTE ``walked``: (fid, z, x, y) of all tiles of the levels that the edges (fid, x1, y1, x2, y2) go through."""
    n = "(1 << CAST(z AS INTEGER))"
    rise = "CASE WHEN a1 = a2 THEN {0} WHEN {1} = a1 THEN b1 WHEN {1} = a2 THEN b2 ELSE b1 + (b2 - b1) * (({1} - a1) / (a2 - a1)) END"
    row = f"CAST(greatest(0, least({n} - 1, floor({{0}}(ya, yb)))) AS BIGINT)"
    return f"""scaled AS (SELECT fid, z, u1 * {n} AS a1, u2 * {n} AS a2, v1 * {n} AS b1, v2 * {n} AS b2 FROM (SELECT fid, {_mercator('x1', 'y1', '1')}, {_mercator('x2', 'y2', '2')} FROM {edges}), {levels} r(z)),
columns AS (SELECT *, unnest(range(CAST(greatest(0, least({n} - 1, floor(least(a1, a2)))) AS BIGINT), CAST(greatest(0, least({n} - 1, floor(greatest(a1, a2)))) AS BIGINT) + 1)) AS x FROM scaled),
sides AS (SELECT *, CASE WHEN x = 0 THEN least(a1, a2) ELSE greatest(least(a1, a2), x::DOUBLE) END AS xa, CASE WHEN x = {n} - 1 THEN greatest(a1, a2) ELSE least(greatest(a1, a2), (x + 1)::DOUBLE) END AS xb FROM columns),
heights AS (SELECT *, {rise.format('b1', 'xa')} AS ya, {rise.format('b2', 'xb')} AS yb FROM sides),
walked AS (SELECT DISTINCT fid, CAST(z AS INTEGER) AS z, x, unnest(range({row.format('least')}, {row.format('greatest')} + 1)) AS y FROM heights)"""


@query("tile_counts_lines", f"""WITH {_EDGES}, {_walked('line_edges', 'range(7)')}
SELECT z, x, y, count(*) AS cnt, 0 AS inside FROM walked GROUP BY z, x, y""")
def tile_counts_lines(spark, sf):
    """Lines across the whole map, whose tiles double with each level: 7 levels. Short lines: ``tile_counts_paths``."""
    return V.tile_counts(D.lines(spark, sf), 7, key="fid")


_PATHS = D.PARCEL_POINTS + """,
path_edges AS (
  SELECT struct_pack(a := fid, b := line) AS fid, x AS x1, y AS y1, x + CAST(0.002 AS DOUBLE) AS x2, y + CAST(line AS DOUBLE) / CAST(1000 AS DOUBLE) AS y2 FROM parcel_points
  UNION ALL SELECT struct_pack(a := fid, b := line), x + CAST(0.002 AS DOUBLE), y + CAST(line AS DOUBLE) / CAST(1000 AS DOUBLE), x + CAST(0.003 AS DOUBLE), y FROM parcel_points)"""


@query("tile_counts_paths", f"""WITH {_PATHS}, {_walked('path_edges', 'range(20)')}
SELECT z, x, y, count(*) AS cnt, 0 AS inside FROM walked GROUP BY z, x, y""")
def tile_counts_paths(spark, sf):
    """Lines of two edges over all 20 levels."""
    return V.tile_counts(D.parcel_paths(spark, sf), key="key")


@query("tile_raster_paths", f"""WITH {_PATHS}, {_walked('path_edges', 'range(15, 17)')}
SELECT z - 8 AS z, x >> 8 AS x, y >> 8 AS y, x & 255 AS px, y & 255 AS py, count(*) AS cnt FROM walked GROUP BY ALL""")
def tile_raster_paths(spark, sf):
    """Pixels of lines on two levels."""
    return V.tile_raster(D.parcel_paths(spark, sf), 9, first=7, points=False, key="key")


@query("tile_counts_boxes", f"""WITH {D.PARCELS}, boxes AS (SELECT code, {_mercator('x0', 'y1', '0')}, {_mercator('x1', 'y0', '1')} FROM parcels),
ranges AS (
  SELECT code, CAST(z AS INTEGER) AS z, {_tile('u0', 'CAST(z AS INTEGER)')} AS c0, {_tile('u1', 'CAST(z AS INTEGER)')} AS c1,
    {_tile('v0', 'CAST(z AS INTEGER)')} AS r0, {_tile('v1', 'CAST(z AS INTEGER)')} AS r1 FROM boxes, range(20) t(z)),
tiles AS (SELECT *, unnest(range(r0, r1 + 1)) AS y FROM (SELECT *, unnest(range(c0, c1 + 1)) AS x FROM ranges)),
told AS (SELECT *, x > c0 AND x < c1 AND y > r0 AND y < r1 AS inside,
  (x >> 1) > (c0 >> 1) AND (x >> 1) < (c1 >> 1) AND (y >> 1) > (r0 >> 1) AND (y >> 1) < (r1 >> 1) AS parent_inside FROM tiles)
SELECT z, x, y, count(*) FILTER (WHERE NOT inside) AS cnt, count(*) FILTER (WHERE inside) AS inside FROM told WHERE NOT parent_inside GROUP BY z, x, y""")
def tile_counts_boxes(spark, sf):
    """Boxes over all 20 levels: outlines, and inside tiles whose parents are not inside."""
    return V.tile_counts(D.parcels(spark, sf), key="code")


@query("tile_raster", f"""WITH {D.POINTS}, {_MERC}, deep AS (
  SELECT CAST(z AS INTEGER) AS z, {_tile('u', 'CAST(z + 8 AS INTEGER)')} AS x8, {_tile('v', 'CAST(z + 8 AS INTEGER)')} AS y8
  FROM merc, range(4) r(z))
SELECT z, x8 >> 8 AS x, y8 >> 8 AS y, x8 & 255 AS px, y8 & 255 AS py, count(*) AS cnt FROM deep GROUP BY ALL""")
def tile_raster(spark, sf):
    return V.tile_raster(D.points(spark, sf), 4)


@query("tile_lookup", f"""WITH {D.POINTS}, {_MERC}
SELECT 'tile-5-' || x || '-' || y || '.png' AS url, cnt FROM (
  SELECT {_tile('u', '5')} AS x, {_tile('v', '5')} AS y, count(*) AS cnt FROM merc GROUP BY 1, 2) WHERE x = 17 AND y = 12""")
def tile_lookup(spark, sf):
    """One tile of a stored pyramid of all levels."""
    path = scratch_path(spark, "pyramid")
    V.write_pyramid(V.tile_counts(D.points(spark, sf), points=True), path)
    hit = V.tile_lookup(spark.read.parquet(path), 5, 17, 12)
    return hit.select(V.tile_url(F.col("z"), F.col("x"), F.col("y")).alias("url"), "cnt")


# ---------------------------------------------------------------- text

@query("to_wkt", f"WITH {D.POINTS} SELECT fid, 'POINT(' || x || ' ' || y || ')' AS wkt FROM points")
def to_wkt(spark, sf):
    return D.points(spark, sf).select("fid", F.expr(X.to_wkt("geom")).alias("wkt"))


@query("trips_to_wkt", f"""WITH {D.TRIPS}
SELECT fid, 'LINESTRING(' || string_agg(x || ' ' || y, ',' ORDER BY i) || ')' AS wkt FROM trip_vertices GROUP BY fid""")
def trips_to_wkt(spark, sf):
    return D.trips(spark, sf).select("fid", F.expr(X.to_wkt("geom")).alias("wkt"))


_FEATURE = """'{"type":"Feature","properties":{"fid":' || fid || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":'
  || o_totalprice || ',"o_orderpriority":"' || o_orderpriority || '"},"geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']}}'"""


@query("to_geojson", f"WITH {D.POINTS} SELECT fid, {_FEATURE} AS feature FROM points")
def to_geojson(spark, sf):
    p = D.points(spark, sf)
    return p.select("fid", Q.feature_json(p).alias("feature"))


@query("to_geojson_document", f"""WITH {D.POINTS}
SELECT CASE WHEN fid = (SELECT min(fid) FROM points) THEN 1 ELSE 2 END AS part, CASE WHEN fid = (SELECT min(fid) FROM points) THEN '' ELSE ',' END || {_FEATURE} AS line FROM points
UNION ALL SELECT 0, '{{"type":"FeatureCollection","features":[' UNION ALL SELECT 3, ']}}'""")
def to_geojson_document(spark, sf):
    from mapshelf.operators.sinks import feature_collection
    return feature_collection(D.points(spark, sf), "fid").select("part", "line")


@query("to_json_wkt", f"""WITH {D.POINTS}
SELECT '{{"fid":' || fid || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || ',"o_orderpriority":"'
  || o_orderpriority || '","wkt":"POINT(' || x || ' ' || y || ')"}}' AS line FROM points""")
def to_json_wkt(spark, sf):
    from mapshelf.operators.sinks import json_wkt_lines
    return json_wkt_lines(D.points(spark, sf))


@query("to_kml", f"""WITH {D.POINTS}
SELECT '<Placemark><ExtendedData><Data name="fid"><value>' || fid || '</value></Data><Data name="o_orderpriority"><value>'
  || o_orderpriority || '</value></Data></ExtendedData><Point><coordinates>' || x || ',' || y
  || '</coordinates></Point></Placemark>' AS line FROM points""")
def to_kml(spark, sf):
    from mapshelf.operators.sinks import kml_lines
    return kml_lines(D.points(spark, sf).select("fid", "o_orderpriority", "geom"))


@query("to_csv_point", f"WITH {D.POINTS} SELECT x, y, CAST(fid AS VARCHAR) AS fid, o_orderpriority FROM points")
def to_csv_point(spark, sf):
    from mapshelf.operators.sinks import csv_columns
    return csv_columns(D.points(spark, sf).select("fid", "o_orderpriority", "geom"), points=True)


@query("attributes_json", f"""WITH {D.EVENT_POINTS}
SELECT event_id, '{{"user_id":' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"event_type":"' || event_type || '"' END
  || ',"big":' || CASE WHEN user_id > 50 THEN 'true' ELSE 'false' END || ',"tags":["a","' || event_type || '"],"m":{{"k":'
  || event_id % 10 || '}}}}' AS record FROM event_points""")
def attributes_json(spark, sf):
    e = D.event_points(spark, sf).select(
        "event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"),
        (F.col("user_id") > 50).alias("big"), F.array(F.lit("a"), F.col("event_type")).alias("tags"),
        F.create_map(F.lit("k"), F.col("event_id") % 10).alias("m"))
    return e.select("event_id", Q.attributes_json(e, ["user_id", "event_type", "big", "tags", "m"]).alias("record"))

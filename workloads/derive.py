"""Feature tables derived from the given tables, in Spark and in SQL.

Coordinates come from integer keys by whole-number arithmetic and one division, so both
engines hold the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pointed(df: DataFrame, *attributes: str) -> DataFrame:
    return df.selectExpr(*attributes, f"{G.point('xmin', 'ymin')} AS geom", "xmin", "ymin", "xmin AS xmax", "ymin AS ymax")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS fid", "o_orderstatus", "o_totalprice", "o_orderpriority",
        "double((o_orderkey * 7919) % 36000) / 100D - 180D AS xmin",
        "double((o_orderkey * 104729 + o_custkey) % 17000) / 100D - 85D AS ymin")
    return _pointed(df, "fid", "o_orderstatus", "o_totalprice", "o_orderpriority")


POINTS = """points AS (
  SELECT o_orderkey AS fid,
         CAST((o_orderkey * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS x,
         CAST((o_orderkey * 104729 + o_custkey) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE) AS y,
         o_orderstatus, o_totalprice, o_orderpriority
  FROM orders)"""


def points_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "l_quantity", "double((l_partkey * 7919) % 36000) / 100D - 180D AS xmin",
        "double((l_orderkey * 104729 + l_suppkey) % 17000) / 100D - 85D AS ymin")
    return _pointed(df, "l_returnflag", "l_quantity")


POINTS_BIG = """points_big AS (
  SELECT CAST((l_partkey * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS x,
         CAST((l_orderkey * 104729 + l_suppkey) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE) AS y,
         l_returnflag, l_quantity
  FROM lineitem)"""

TRIP_LENGTH = 64


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "double((event_id * 37) % 36000) / 100D - 180D AS xmin",
        "double((event_id * 53) % 17000) / 100D - 85D AS ymin")
    return _pointed(df, "event_id", "user_id", "event_type")


EVENT_POINTS = """event_points AS (
  SELECT event_id, user_id, event_type,
         CAST((event_id * 37) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS x,
         CAST((event_id * 53) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE) AS y
  FROM events)"""


def trips(spark: SparkSession, sf_dir: str, kind: str = "LineString") -> DataFrame:
    """Lines (or MultiPoints) through 64 consecutive events. The event number bounds every
    trip, however many events one user has."""
    e = event_points(spark, sf_dir).select(
        F.floor(F.col("event_id") / TRIP_LENGTH).alias("fid"), "event_id", "xmin", "ymin")
    ordered = e.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("event_id", "xmin", "ymin"))).alias("v"))
    vertices = f"transform(v, _t -> {G.vertex('_t.xmin', '_t.ymin')})"
    shape = G.multipoint(vertices) if kind == "MultiPoint" else G.line(vertices, kind)
    return ordered.selectExpr("fid", f"{shape} AS geom")


TRIPS = EVENT_POINTS + """,
trip_vertices AS (
  SELECT event_id // 64 AS fid, row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1 AS i,
         x, y FROM event_points)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of 32 vertices per embedding."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS fid", "label", "cast(embedding as array<double>) AS e")
    vertex = G.vertex("get(e, _i * 2) * 180D", "get(e, _i * 2 + 1) * 85D")
    return e.selectExpr("fid", "label", f"{G.line(f'transform(sequence(0, 31), _i -> {vertex})')} AS geom")


LINES = """line_vertices AS (
  SELECT vec_id AS fid, label, i,
         CAST(embedding[2 * i + 1] AS DOUBLE) * CAST(180 AS DOUBLE) AS x,
         CAST(embedding[2 * i + 2] AS DOUBLE) * CAST(85 AS DOUBLE) AS y
  FROM embeddings, range(32) r(i))"""


RADIUS = 20.005   # no point of the 0.01 grid lies on the edge of a diamond
DIAMOND = [(-RADIUS, 0.0), (0.0, -RADIUS), (RADIUS, 0.0), (0.0, RADIUS), (-RADIUS, 0.0)]


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles for even nations and diamonds for odd ones."""
    base = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = base.selectExpr(
        "n_nationkey AS position", "n_name AS code", "concat('Nation ', n_nationkey) AS display_name",
        "array(n_name, r_name) AS search_names", "double((n_nationkey % 5) * 72 - 144) + 0.005D AS cx",
        "double((n_nationkey div 5) * 30 - 60) + 0.005D AS cy")
    diamond = G.polygon(f"array({G.ring_of(*[(f'cx + {dx}D', f'cy + {dy}D') for dx, dy in DIAMOND])})")
    rectangle = G.box_polygon("cx - 25D", "cy - 10D", "cx + 25D", "cy + 10D")
    return base.selectExpr("position", "code", "display_name", "search_names",
                           f"if(position % 2 = 0, {rectangle}, {diamond}) AS geom")


REGIONS = """regions AS (
  SELECT n_nationkey AS position, n_name AS code, 'Nation ' || n_nationkey AS display_name, r_name,
         CAST((n_nationkey % 5) * 72 - 144 AS DOUBLE) + CAST(0.005 AS DOUBLE) AS cx,
         CAST((n_nationkey // 5) * 30 - 60 AS DOUBLE) + CAST(0.005 AS DOUBLE) AS cy
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

IN_REGION = """(CASE WHEN position % 2 = 0 THEN abs(x - cx) <= 25 AND abs(y - cy) <= 10
               ELSE abs(x - cx) + abs(y - cy) <= 20.005 END)"""


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each order, in a cell of a grid of 0.01 degrees; all lie within 5.5 by 2.8 degrees. No point is on an edge."""
    at = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS code", "double((o_orderkey * 7919) % 550) / 100D AS x", "double((o_orderkey * 104729 + o_custkey) % 280) / 100D AS y")
    return at.selectExpr("code", f"{G.box_polygon('x + 0.0015D', 'y + 0.0015D', 'x + 0.0085D', 'y + 0.0085D')} AS geom")


PARCELS = """parcels AS (
  SELECT o_orderkey AS code, (o_orderkey * 7919) % 550 AS gx, (o_orderkey * 104729 + o_custkey) % 280 AS gy,
         CAST(gx AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.0015 AS DOUBLE) AS x0, CAST(gx AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.0085 AS DOUBLE) AS x1,
         CAST(gy AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.0015 AS DOUBLE) AS y0, CAST(gy AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.0085 AS DOUBLE) AS y1
  FROM orders)"""


def parcel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items at places of a grid of 0.001 degrees over the parcels."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS fid", "l_linenumber AS line", "double((l_partkey * 7919) % 5500) / 1000D AS xmin",
        "double((l_orderkey * 104729 + l_suppkey) % 2800) / 1000D AS ymin")
    return _pointed(df, "fid", "line")


def parcel_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of two edges from each of these points, up or down by the item's number and back."""
    tip = G.vertex("xmin + 0.002D", "ymin + double(line) / 1000D")
    vertices = f"array({G.vertex('xmin', 'ymin')}, {tip}, {G.vertex('xmin + 0.003D', 'ymin')})"
    return parcel_points(spark, sf_dir).selectExpr("struct(fid, line) AS key", f"{G.line(vertices)} AS geom")


PARCEL_POINTS = """parcel_points AS (
  SELECT l_orderkey AS fid, l_linenumber AS line, (l_partkey * 7919) % 5500 // 10 AS gx, (l_orderkey * 104729 + l_suppkey) % 2800 // 10 AS gy,
         CAST((l_partkey * 7919) % 5500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS x, CAST((l_orderkey * 104729 + l_suppkey) % 2800 AS DOUBLE) / CAST(1000 AS DOUBLE) AS y
  FROM lineitem)"""


STATUSES = ["created", "downloaded", "decompressed", "summarized", "indexed", "ready", "published"]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key, n = F.col("doc_id"), F.col("n_chars")
    return d.select(
        F.lpad(F.hex(key), 24, "0").alias("_id"), F.concat("source", F.lit("/"), key.cast("string")).alias("name"),
        F.concat(F.lit("Title "), key.cast("string")).alias("title"),
        F.col("text").alias("description"), F.lit("csv").alias("format"), F.array("lang", "source").alias("tags"),
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (key % 7 + 1).cast("int")).alias("status"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=key.cast("int"))).alias("modifiedAt"),
        (n * 1000).alias("size"), n.alias("num_features"),
        F.when(key % 150 != 0, n * (F.lit(1) + key % 150)).alias("num_points"),
        F.lit("Point").alias("geometry_type"),
        F.concat("source", F.lit("/"), key.cast("string"), F.lit("/data_index")).alias("index_path"))


CATALOG = """catalog AS (
  SELECT lpad(printf('%X', doc_id), 24, '0') AS _id, source || '/' || doc_id AS name, 'Title ' || doc_id AS title,
         text AS description, 'csv' AS format, [lang, source] AS tags, doc_id, lang, source,
         (['created','downloaded','decompressed','summarized','indexed','ready','published'])[CAST(doc_id % 7 + 1 AS INTEGER)] AS status,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS modifiedAt,
         n_chars * 1000 AS size, n_chars AS num_features,
         CASE WHEN doc_id % 150 <> 0 THEN n_chars * (1 + doc_id % 150) END AS num_points,
         'Point' AS geometry_type, source || '/' || doc_id || '/data_index' AS index_path
  FROM documents)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form per page, with links of five kinds and options of several forms."""
    p = table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    kind = F.col("page_id") % 5
    link = (
        F.when(kind == 1, F.concat(F.lit("https://drive.google.com/open?id=ID"), key, F.lit("&usp=sharing")))
        .when(kind == 2, F.concat(F.lit("https://drive.google.com/file/d/F"), key, F.lit("/view")))
        .when(kind == 3, F.concat(F.lit("https://www.dropbox.com/s/k"), key, F.lit("/data.zip?dl=0")))
        .when(kind == 4, F.concat(F.lit("https://onedrive.live.com/edit/file/d/O"), key))
        .otherwise(F.col("url")))
    return p.select(
        "page_id", link.alias("link"),
        F.concat(F.lit("Page "), key).alias("title"), F.lit("").alias("description"), F.concat(F.lit("p/"), key).alias("name"),
        F.lit("someone").alias("author"), F.lit("a@example.com").alias("email"), F.col("url").alias("project_homepage"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  "), link, F.lit(" \r\n "), F.col("url"), F.lit("\n")))
        .otherwise(link).alias("urls"),
        F.when(kind == 2, F.lit("geojson")).otherwise(F.lit("csv")).alias("format"),
        F.when(kind == 3, F.lit("wkt")).when(kind == 4, F.lit("other")).otherwise(F.lit("point")).alias("geometry_type"),
        F.when(kind == 0, F.lit("lon")).otherwise(F.lit("")).alias("x_column"),
        F.when(kind == 0, F.lit("lat")).alias("y_column"), F.when(F.col("page_id") % 2 == 0, F.lit("3")).alias("wkt_column"),
        F.when(F.col("page_id") % 4 == 0, F.lit(";")).otherwise(F.lit("")).alias("delimiter"),
        F.when(F.col("page_id") % 2 == 0, F.lit("on")).alias("skipheader"),
        F.when(F.col("page_id") % 7 == 0, F.lit("Other")).otherwise(F.lit("CC0")).alias("license"),
        F.lit("my own").alias("license_other"), F.concat(F.lit("a,b"), key).alias("tags"))


SUBMISSIONS = """submissions AS (
  SELECT page_id, CASE page_id % 5
           WHEN 1 THEN 'https://drive.google.com/open?id=ID' || page_id || '&usp=sharing'
           WHEN 2 THEN 'https://drive.google.com/file/d/F' || page_id || '/view'
           WHEN 3 THEN 'https://www.dropbox.com/s/k' || page_id || '/data.zip?dl=0'
           WHEN 4 THEN 'https://onedrive.live.com/edit/file/d/O' || page_id
           ELSE url END AS link, url FROM pages)"""

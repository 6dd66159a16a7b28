"""File readers. Each gives a feature DataFrame with a ``geom`` column and the attributes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions.textgeom import from_geojson, from_wkt
from mapshelf.operators.options import normalize_options

# No field of a delimited file equals this, so empty fields stay empty text.
NO_NULL = "\u0000"


def _delimited(spark: SparkSession, path, sep: str, header: bool, glob: str | None = None,
               schema: str | None = None) -> DataFrame:
    # Without column pruning every field of a row is parsed, so a row of another width fails the job.
    reader = spark.read.option("recursiveFileLookup", "true").option("columnPruning", "false")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema:
        reader = reader.schema(schema)
    raw = reader.csv(path, sep=sep, header=header, quote='"', escape='"', nullValue=NO_NULL,
                     emptyValue="", mode="FAILFAST")
    # The parser gives NULL for an empty field without quotes.
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def _column(df: DataFrame, ref: int | str) -> str:
    """A column by name, or by position in the file."""
    if isinstance(ref, str) and ref in df.columns:
        return ref
    if isinstance(ref, int) or str(ref).isdigit():
        return df.columns[int(ref)]
    raise ValueError(f"No column '{ref}' in {df.columns}")


def read_csv_points(spark: SparkSession, path, x: int | str = 0, y: int | str = 1, sep: str = ",",
                    header: bool = False) -> DataFrame:
    """Points from two columns; the other columns are text attributes. A bad number fails the job.

    The flat box columns come along, so later steps need not look into the geometry.
    """
    raw = _delimited(spark, path, sep, header)
    cx, cy = _column(raw, x), _column(raw, y)
    rest = [c for c in raw.columns if c not in (cx, cy)]
    placed = raw.select(*rest, F.expr(f"double(`{cx}`)").alias("xmin"), F.expr(f"double(`{cy}`)").alias("ymin"))
    return placed.selectExpr(*[f"`{c}`" for c in rest], f"{G.point('xmin', 'ymin')} AS geom",
                             "xmin", "ymin", "xmin AS xmax", "ymin AS ymax")


def read_csv_wkt(spark: SparkSession, path, col: int | str = 0, sep: str = ",", header: bool = False) -> DataFrame:
    """Geometries from a WKT column; the other columns are text attributes."""
    raw = _delimited(spark, path, sep, header)
    c = _column(raw, col)
    return raw.select(*[k for k in raw.columns if k != c], F.expr(from_wkt(f"`{c}`")).alias("geom"))


def read_csv_segments(spark: SparkSession, path, columns: str, header: bool = False) -> DataFrame:
    """Two-point lines from four columns x1, y1, x2, y2; other columns are text attributes."""
    raw = _delimited(spark, path, ",", header)
    ends = [raw.columns[int(i)] for i in columns.split(",")]
    x1, y1, x2, y2 = [f"`{c}`" for c in ends]
    shape = G.line(G.ring_of((x1, y1), (x2, y2)))
    return raw.select(*[c for c in raw.columns if c not in ends], F.expr(shape).alias("geom"))


GEOLIFE_HEADER = 6


def read_geolife(spark: SparkSession, path, glob: str = "*.plt") -> DataFrame:
    """GPS traces ``*.plt``: six header lines, then lat, lon, reserved, altitude, days, date, time.

    A trace file is read as one text, so that header lines are known by their number; a record
    with too few fields or a bad number fails the job.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(
        path, wholetext=True)
    lines = files.selectExpr(r"posexplode(split(value, r'\r\n|\n|\r')) AS (n, line)")
    rows = lines.where(f"n >= {GEOLIFE_HEADER} and line <> ''").selectExpr("split(line, ',') AS p")
    # The index operator fails on a missing field.
    return rows.selectExpr(
        f"{G.point('p[1]', 'p[0]')} AS geom", "element_at(p, 3) AS Unused", "double(element_at(p, 4)) AS Altitude",
        "double(element_at(p, 5)) AS Date_Days", "element_at(p, 6) AS Date", "element_at(p, 7) AS Time")


PORTO_FILE = ("TRIP_ID string, CALL_TYPE string, ORIGIN_CALL string, ORIGIN_STAND string, TAXI_ID string, "
              "TIMESTAMP string, DAY_TYPE string, MISSING_DATA string, POLYLINE string")


def read_porto(spark: SparkSession, path, unit: str = "ms") -> DataFrame:
    """Taxi trips with a list of positions as a MultiPoint. The epoch number counts as
    milliseconds; ``unit="s"`` reads it as seconds."""
    raw = _delimited(spark, path, ",", True, schema=PORTO_FILE)
    moment = "timestamp_millis" if unit == "ms" else "timestamp_seconds"
    shown = raw.selectExpr(
        "bigint(TRIP_ID) AS TRIP_ID", "CALL_TYPE", "ORIGIN_CALL", "ORIGIN_STAND", "int(TAXI_ID) AS TAXI_ID",
        f"{moment}(bigint(TIMESTAMP)) AS TIMESTAMP", "DAY_TYPE", "lower(MISSING_DATA) = 'true' AS MISSING_DATA",
        r"from_json(concat('[', regexp_replace(POLYLINE, r'[\[\]\s]', ''), ']'), 'array<double>', "
        "map('mode', 'FAILFAST')) AS _c")
    vertices = ("case when size(_c) % 2 = 1 then raise_error('Must have even number of coordinates') "
                f"when size(_c) > 0 then transform(sequence(0, int(size(_c) / 2) - 1), _pi -> "
                f"{G.vertex('get(_c, _pi * 2)', 'get(_c, _pi * 2 + 1)')}) else cast(array() as array<{G.VERTEX}>) end")
    return shown.selectExpr("*", f"{G.multipoint(vertices)} AS geom").drop("_c")


FEATURE = "type string, geometry string, properties string"


def _geojson_files(spark: SparkSession, path) -> tuple[list[str], list[str]]:
    """Files that hold every feature on a line of its own, and the others.

    In the former, lines other than objects only open and close a collection, in the file or, as in an exported document,
    over the files of a folder. A file that opens more than is closed is not among them, so it is parsed as a
    whole and fails. One row per file is collected, as for any listing of files.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.regexp_replace("value", r"^[\s,]+|[\s,]+$", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    item = F.startswith("line", F.lit("{")) & F.endswith("line", F.lit("}"))
    found = lines.where("line <> ''").groupBy("file").agg(
        F.bool_or(~item & (F.col("line").rlike(r'"(geometry|geometries|coordinates)"') | ~F.col("line").rlike(r'^[{}\]"]'))).alias("split"),
        F.sum(F.when(~item & F.col("line").rlike(r'"features"\s*:\s*\[$'), 1).when(~item & F.startswith("line", F.lit("]")), -1)
              .when(~item & F.col("line").rlike(r"\[[^\]]*$"), 1).otherwise(0)).alias("open"), F.bool_or(item).alias("items")).collect()
    closed = sum(r["open"] for r in found if not r["split"]) == 0
    apart = {r["file"]: not r["split"] and (closed or r["items"] and r["open"] == 0) for r in found}
    return [f for f, ok in apart.items() if ok], [f for f, ok in apart.items() if not ok]


def read_geojson(spark: SparkSession, path, properties: str = "map<string,string>",
                 lines: bool | None = None) -> DataFrame:
    """Features of FeatureCollections; ``properties`` is the type of that object, and the fields
    of a struct become columns.

    Files that hold every feature on a line of its own, bare or within the lines of a collection
    as the GeoJSON export writes them, split over tasks whatever their size. Any other file is one JSON value and is
    read by one task. Which of both a file is, is found file by file; ``lines`` says it for all. Text that is not JSON, a
    cut-off collection or a second value in a file fails the job.
    """
    whole = f"{FEATURE}, features array<struct<{FEATURE.replace(' string', ':string')}>>"
    parsed = f"from_json(%s, '{whole}', map('mode', 'FAILFAST')) AS c"
    apart, together = ([path], []) if lines else ([], [path]) if lines is False else _geojson_files(spark, path)
    read = spark.createDataFrame([], f"c struct<{whole.replace('type string, geometry string, properties string, ', 'type:string,geometry:string,properties:string,').replace('features ', 'features:')}>")
    if apart:
        text = spark.read.option("recursiveFileLookup", "true").text(apart[0] if lines else apart).selectExpr(
            r"regexp_replace(value, r'^[\s,]+|[\s,]+$', '') AS line")
        read = read.unionByName(text.where("startswith(line, '{') and endswith(line, '}')").selectExpr(parsed % "line"))
    if together:
        text = spark.read.option("recursiveFileLookup", "true").text(together[0] if lines is False else together, wholetext=True)
        # Outside of strings, valid JSON never has an object right after another.
        bare = F.regexp_replace("value", r'"(?:\\.|[^"\\])*+"', "")
        several = F.raise_error(F.lit("Several JSON values in a file")).cast("string")
        one = text.where("trim(value) <> ''").select(F.when(bare.rlike(r"\}\s*\{"), several).otherwise(F.col("value")).alias("value"))
        read = read.unionByName(one.selectExpr(parsed % "value"))
    f = read.select("c.*").selectExpr("explode(case when features is not null then features when type = 'Feature' "
                                      "then array(struct(type, geometry, properties)) end) AS f")
    typed = f.selectExpr(f"from_json(f.properties, '{properties}') AS properties", f"{from_geojson('f.geometry')} AS geom")
    return typed.select("properties.*", "geom") if properties.startswith("struct<") else typed


def read_rtree(spark: SparkSession, path) -> DataFrame:
    """An indexed dataset."""
    from mapshelf.operators.indexing import indexed_input, read_index
    return indexed_input(read_index(spark, path))


def _yes(options: dict[str, str], key: str) -> bool:
    return str(options.get(key, "false")).lower() == "true"


def _points(spark, path, args: list[str], options: dict[str, str]) -> DataFrame:
    ref = [int(a) if a.isdigit() else a for a in args] + [0, 1][len(args):]
    return read_csv_points(spark, path, ref[0], ref[1], options.get("separator", ","), _yes(options, "skipheader"))


def _wkt(spark, path, args: list[str], options: dict[str, str]) -> DataFrame:
    col = (int(args[0]) if args[0].isdigit() else args[0]) if args else 0
    return read_csv_wkt(spark, path, col, options.get("separator", ","), _yes(options, "skipheader"))


READERS: dict[str, Callable[..., DataFrame]] = {
    "point": _points,
    "wkt": _wkt,
    "csvline": lambda spark, path, args, o: read_csv_segments(spark, path, o["columns"]),
    "geolife": lambda spark, path, args, o: read_geolife(spark, path),
    "porto": lambda spark, path, args, o: read_porto(spark, path),
    "geojson": lambda spark, path, args, o: read_geojson(spark, path),
    "rtree": lambda spark, path, args, o: read_rtree(spark, path),
}


def register_reader(name: str, reader: Callable[..., DataFrame]) -> None:
    """Add a format: ``reader(spark, path, args, options)``."""
    READERS[name] = reader


def read_dataset(spark: SparkSession, path, options: dict[str, str]) -> DataFrame:
    """Read by the ``iformat`` option, such as ``point(1,2)`` or ``geojson``."""
    spec = options.get("iformat") or ""
    match = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", spec)
    if not match or match.group(1) not in READERS:
        raise ValueError(f"Unrecognized input format '{spec}'")
    args = [a.strip() for a in match.group(2).split(",")] if match.group(2) else []
    return READERS[match.group(1)](spark, path, args, options)


CATALOG_DOCUMENT = (
    "_id struct<`$oid`:string>, name string, title string, description string, author string, email string, "
    "project_homepage string, license string, format string, download_url string, "
    "download_urls array<string>, tags array<string>, status string, modifiedAt struct<`$date`:string>, "
    "size long, num_features long, num_points long, geometry_type string, extent array<double>, "
    "avg_sidelength array<double>, attributes array<struct<name:string,type:string>>, index_path string, "
    "visualization struct<type:string,url:string>, date_created long")


def read_catalog_json(spark: SparkSession, path, options_field: str = "options") -> DataFrame:
    """JSON array of catalog documents with ``_id.$oid`` and ``modifiedAt.$date``.

    The reader options under ``options_field`` may be text, a list or an object.
    """
    raw = spark.read.schema(f"{CATALOG_DOCUMENT}, `{options_field}` string").json(path, multiLine=True)
    given = F.col(f"`{options_field}`")
    is_object, is_list = F.startswith(given, F.lit("{")), F.startswith(given, F.lit("["))
    options = normalize_options(
        text=F.when(~is_object & ~is_list, given), items=F.when(is_list, F.from_json(given, "array<string>")),
        mapping=F.when(is_object, F.from_json(given, "map<string,string>")))
    plain = [c for c in raw.columns if c not in ("_id", "modifiedAt", options_field)]
    return raw.select(
        F.col("_id")["$oid"].alias("_id"), *plain, F.to_timestamp(F.col("modifiedAt")["$date"]).alias("modifiedAt"),
        options.alias("options"))

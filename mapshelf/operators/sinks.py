"""Exports: CSV, GeoJSON, KML and JSON with WKT, plain or compressed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapshelf.functions import geometry as G
from mapshelf.functions.textgeom import to_kml, to_wkt, xml_escape
from mapshelf.operators.documents import framed, json_document, write_document
from mapshelf.operators.spatial_filter import feature_json

PART_BYTES = 33554432

# Suffix of a compressed file to codec, and media types by extension.
CODECS = {"gz": "gzip", "bz2": "bzip2", "deflate": "deflate", "lz4": "lz4", "snappy": "snappy"}
MEDIA_TYPES = {
    "csv": "text/csv",
    "geojson": "application/geo+json",
    "kml": "application/vnd.google-earth.kml+xml",
    "kmz": "application/vnd.google-earth.kmz",
    "zip": "application/zip",
}


def _text(df: DataFrame, c: str) -> str:
    nested = isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
    return f"to_json(`{c}`)" if nested else f"string(`{c}`)"


def csv_columns(df: DataFrame, points: bool) -> DataFrame:
    """Geometry as ``x``, ``y`` or ``wkt`` first, then the attributes as text."""
    names = G.attribute_columns(df)
    if points:
        place = [f"{G.xmin('geom')} AS x", f"{G.ymin('geom')} AS y"]
    else:
        place = [f"{to_wkt('geom')} AS wkt"]
    return df.select(*[F.expr(p) for p in place], *[F.expr(_text(df, c)).alias(c) for c in names])


def write_csv(df: DataFrame, path: str, points: bool, sep: str = ",", header: bool = False,
              compression: str = "none", max_records: int = 0) -> None:
    writer = csv_columns(df, points).write.mode("errorifexists")
    writer.option("maxRecordsPerFile", max_records).csv(
        path, sep=sep, header=header, compression=compression, emptyValue="")


def geojson_lines(df: DataFrame) -> DataFrame:
    return df.select(feature_json(df).alias("line"))


def json_wkt_lines(df: DataFrame) -> DataFrame:
    """One JSON record per feature with a ``wkt`` field after the attributes."""
    names = G.attribute_columns(df)
    return df.select(F.to_json(F.struct(*names, F.expr(to_wkt("geom")).alias("wkt"))).alias("line"))


def kml_lines(df: DataFrame) -> DataFrame:
    """One Placemark per feature with the attributes as extended data."""
    data = ["coalesce(concat('<Data name=\"" + c + "\"><value>', " + xml_escape(_text(df, c)) + ", '</value></Data>'), '')"
            for c in G.attribute_columns(df)]
    extended = ", ".join(["'<ExtendedData>'", *data, "'</ExtendedData>'"]) if data else "''"
    return df.selectExpr(f"concat('<Placemark>', {extended}, coalesce({to_kml('geom')}, ''), '</Placemark>') AS line")


KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
KML_TAIL = "</Document></kml>"


def feature_collection(df: DataFrame, key: str) -> DataFrame:
    """Lines of one GeoJSON FeatureCollection; ``key`` is unique and says which feature comes first."""
    body = df.select(F.col(key).alias("sort_key"), feature_json(df).alias("line"))
    return json_document(body, '{"type":"FeatureCollection","features":[', "]}")


def kml_document(df: DataFrame) -> DataFrame:
    """Lines of one KML document."""
    body = kml_lines(df).selectExpr("2 AS part", "cast(null as string) AS sort_key", "line")
    return framed(body, KML_HEAD, KML_TAIL)


def write_lines(lines: DataFrame, path: str, compression: str = "none", max_records: int = 0) -> None:
    lines.write.mode("errorifexists").option("maxRecordsPerFile", max_records).text(path, compression=compression)


@dataclass(frozen=True)
class Target:
    """Where and how an export is written."""
    path: str
    points: bool = False
    sep: str = ","
    key: str | None = None        # unique column of a single document; without it files hold one record per line
    compression: str = "none"
    max_records: int = 0


def _write_geojson(df: DataFrame, t: Target) -> None:
    if t.key:
        write_document(feature_collection(df, t.key), t.path, t.compression, max_records=t.max_records)
    else:
        write_lines(geojson_lines(df), t.path, t.compression, t.max_records)


def _write_kml(df: DataFrame, t: Target) -> None:
    write_document(kml_document(df), t.path, t.compression, max_records=t.max_records)


def _write_csv(df: DataFrame, t: Target) -> None:
    write_csv(df, t.path, t.points, t.sep, compression=t.compression, max_records=t.max_records)


def _write_json(df: DataFrame, t: Target) -> None:
    write_lines(json_wkt_lines(df), t.path, t.compression, t.max_records)


WRITERS: dict[str, Callable[[DataFrame, Target], None]] = {
    "csv": _write_csv, "geojson": _write_geojson, "kml": _write_kml, "kmz": _write_kml, "json": _write_json,
}


def split_format(fmt: str) -> tuple[str, str]:
    """Writer name and codec of an extension such as ``csv.gz``."""
    stem, dot, suffix = fmt.lower().rpartition(".")
    if dot and suffix in CODECS:
        return stem, CODECS[suffix]
    return fmt.lower(), "none"


def media_type(fmt: str) -> str | None:
    """Media type of an extension; NULL text for formats without one."""
    return MEDIA_TYPES.get(split_format(fmt)[0])


def records_per_part(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Records that fill about ``part_bytes``, from the mean length of all records as text."""
    mean = df.agg(F.avg(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0]
    return max(1, int(part_bytes / mean)) if mean else 0


def write_features(df: DataFrame, path: str, fmt: str, points: bool = False, sep: str = ",",
                   key: str | None = None, bounded: bool = False) -> None:
    """Write in the format named by the extension; an unknown one is an error."""
    stem, codec = split_format(fmt)
    if stem not in WRITERS:
        raise ValueError(f"Unrecognized extension '{stem}'")
    limit = records_per_part(df.select(*G.attribute_columns(df), "geom")) if bounded else 0
    WRITERS[stem](df, Target(path, points, sep, key, codec, limit))

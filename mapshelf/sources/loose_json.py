"""Loosely shaped JSON documents to features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mapshelf.functions.geometry import let, text_list
from mapshelf.functions.textgeom import from_geojson

# Keys that may hold the geometry or the records, and the accepted kinds.
GEOMETRY_KEYS = ["geometry", "geom", "shape", "the_geom", "geojson"]
RECORD_KEYS = ["features", "results", "data", "records"]
GEOMETRY_KINDS = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"]
_FALSY = ["null", "false", "0", '""']


def _get(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$.{key}', 'variant')"


def _text(v: str, key: str) -> str:
    """A text field; NULL when it is missing or not text."""
    return f"if(schema_of_variant({_get(v, key)}) = 'STRING', try_variant_get({v}, '$.{key}', 'string'), null)"


def _truthy(v: str) -> str:
    return let(v, "_ty", f"if(to_json(_ty) in ({text_list(_FALSY)}), null, _ty)")


def _first_truthy(v: str, keys: list[str]) -> str:
    return "coalesce(" + ", ".join(_truthy(_get(v, k)) for k in keys) + ")"


def _geometry(v: str) -> str:
    """The geometry of a record as a variant, if its first geometry key holds a known kind."""
    return let(_first_truthy(v, GEOMETRY_KEYS), "_gv",
               f"if({_text('_gv', 'type')} in ({text_list(GEOMETRY_KINDS)}), _gv, null)")


def _as_list(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def _with_geometry(records: str) -> str:
    """The records that have a geometry; NULL when there are none."""
    return let(f"filter({records}, _wg -> {_geometry('_wg')} is not null)", "_wf", "if(size(_wf) > 0, _wf, null)")


def normalize_json_features(df: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record with a geometry: ``keep`` columns, ``position``, ``properties`` (JSON
    text) and ``geom``.

    The records are looked for in a FeatureCollection, a single feature, a single object with a
    geometry, a list under one of the record keys or the document itself, and last in the values
    of the document. A record without ``properties`` that has an ``OBJECTID`` takes its other
    fields as properties.
    """
    docs = df.selectExpr(*keep, f"try_parse_json(`{json}`) AS v")
    docs = docs.selectExpr(*keep, "v", f"{_text('v', 'type')} AS kind", f"{_first_truthy('v', RECORD_KEYS)} AS held")
    found = ", ".join([
        _with_geometry(f"if(kind = 'FeatureCollection', {_as_list(_get('v', 'features'))}, null)"),
        f"if(kind = 'Feature' and {_truthy(_get('v', 'geometry'))} is not null, array(v), null)",
        f"if({_geometry('v')} is not null, array(v), null)",
        _with_geometry(f"if(held is not null, {_as_list('held')}, {_as_list('v')})"),
        _with_geometry("map_values(try_variant_get(v, '$', 'map<string,variant>'))")])
    rows = docs.selectExpr(*keep, f"posexplode(coalesce({found})) AS (position, r)")
    others = ("to_json(map_filter(try_variant_get(r, '$', 'map<string,variant>'), "
              f"(_k, _v) -> _k not in ({text_list(GEOMETRY_KEYS)})))")
    properties = (
        f"case when {_get('r', 'properties')} is null and {_get('r', 'OBJECTID')} is not null "
        f"and not coalesce({_text('r', 'type')} = 'Feature', false) then {others} "
        f"else coalesce(to_json({_truthy(_get('r', 'properties'))}), '{{}}') end")
    shape = f"to_json(coalesce({_geometry('r')}, {_get('r', 'geometry')}))"
    return rows.selectExpr(*keep, "position", f"{properties} AS properties", f"{from_geojson(shape)} AS geom")

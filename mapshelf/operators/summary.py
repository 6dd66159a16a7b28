"""Summaries of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapshelf.functions import geometry as G

# Fixed value: Spark type to the name shown in the catalog.
TYPE_NAMES = {
    "string": "string", "integer": "integer", "long": "integer", "float": "number",
    "double": "number", "boolean": "boolean",
}


def attribute_bytes(df: DataFrame, key: str | None = None) -> str:
    """Text length in bytes of the attributes of a row, as SQL text; NULL counts as zero."""
    total = "0L"
    for c in G.attribute_columns(df):
        if c == key:
            continue
        nested = isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
        text = f"to_json(struct(`{c}`))" if nested else f"string(`{c}`)"
        total += f" + coalesce(octet_length({text}), 0)"
    return f"({total})"


def feature_bytes(df: DataFrame, key: str | None = None) -> str:
    """16 bytes per vertex plus the attribute text, as SQL text."""
    points = "n_points" if "n_points" in df.columns else G.num_points("geom")
    return f"(coalesce({points}, 0) * 16 + {attribute_bytes(df, key)})"


def summarize(features: DataFrame, by: list[str] | None = None, key: str | None = None) -> DataFrame:
    """One row, or one per group: size, counts, geometry type, extent and mean side lengths.

    ``num_points`` is NULL when it equals ``num_features``; ``avg_sidelength`` is NULL unless
    some side is longer than zero. ``by`` and ``key`` columns are not counted as attributes.
    """
    by = by or []
    f = G.with_mbr(features)
    keep = [c for c in f.columns if c not in by]
    shown = f.selectExpr(
        *by, f"{G.num_points('geom')} AS _n", f"{attribute_bytes(f.select(*keep), key)} AS _text",
        f"{G.kind_code('geom')} AS _kind", *G.MBR_COLUMNS)
    # Kinds travel as numbers: text would force the aggregation to sort.
    a = shown.groupBy(*by).agg(*[F.expr(e) for e in (
        "count(*) AS num_features", "coalesce(sum(_n), 0) AS points", "coalesce(sum(_text), 0) AS text_bytes",
        "min(_kind) AS k0", "max(_kind) AS k1", "min(xmin) AS x0", "min(ymin) AS y0", "max(xmax) AS x1",
        "max(ymax) AS y1", "avg(xmax - xmin) AS w", "avg(ymax - ymin) AS h")])
    kinds = f"get(array({G.text_list(G.KINDS)}), k0 - 1)"
    return a.selectExpr(
        *by, "16 * points + text_bytes AS size", "num_features", "nullif(points, num_features) AS num_points",
        f"case when k0 = k1 then coalesce({kinds}, 'GeometryCollection') "
        "when k0 is not null then 'GeometryCollection' end AS geometry_type",
        "if(x0 is not null, array(x0, y0, x1, y1), null) AS extent",
        "if(w + h > 0, array(w, h), null) AS avg_sidelength")


def attribute_types(features: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """(name, type) of the attributes as seen in the first record by ``order``.

    A NULL there gives ``unknown``. No rows when there is nothing but a geometry.
    """
    by = by or []
    names = [c for c in G.attribute_columns(features) if c not in by]
    if not names:
        return features.sparkSession.createDataFrame([], "name string, type string")
    flags = F.struct(*[F.col(c).isNotNull().alias(f"a{i}") for i, c in enumerate(names)])
    if by:
        first = features.groupBy(*by).agg(F.min_by(flags, F.col(order)).alias("first"))
    else:
        # The order column alone finds the record; its attributes are read behind a pushed filter.
        lowest = features.agg(F.min(order)).scalar()
        first = features.where(F.col(order) == lowest).limit(1).select(flags.alias("first"))
    rows = F.array(*[
        F.struct(F.lit(c).alias("name"), F.when(
            F.col("first")[f"a{i}"], F.lit(TYPE_NAMES.get(features.schema[c].dataType.typeName(), "unknown"))
        ).otherwise(F.lit("unknown")).alias("type"))
        for i, c in enumerate(names)])
    return first.where(F.col("first").isNotNull()).select(*by, F.explode(rows).alias("a")).select(*by, "a.name", "a.type")


def partition_stats(indexed: DataFrame, by: str | None = None) -> DataFrame:
    """The manifest: one row per ``part_id``, or per ``by`` and ``part_id``."""
    groups = ([by] if by else []) + ["part_id"]
    f = G.with_mbr(indexed)
    points = "n_points" if "n_points" in f.columns else G.num_points("geom")
    size = "n_bytes" if "n_bytes" in f.columns else feature_bytes(f)
    shown = f.selectExpr(*groups, f"{points} AS _n", f"{size} AS _b", *G.MBR_COLUMNS)
    a = shown.groupBy(*groups).agg(*[F.expr(e) for e in (
        "count(*) AS record_count", "count(xmin) AS nonempty_count", "coalesce(sum(_n), 0) AS num_points",
        "sum(_b) AS data_size", "sum((xmin + xmax) / 2) AS sum_x", "sum((ymin + ymax) / 2) AS sum_y",
        "min(xmin) AS xmin", "min(ymin) AS ymin", "max(xmax) AS xmax", "max(ymax) AS ymax")])
    ring = ["xmin, ' ', ymin", "xmax, ' ', ymin", "xmax, ' ', ymax", "xmin, ' ', ymax", "xmin, ' ', ymin"]
    corners = ", ',', ".join(ring)
    return a.selectExpr("*", f"if(xmin is not null, concat('POLYGON((', {corners}, '))'), null) AS boundary")

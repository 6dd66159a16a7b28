"""Rectangle queries, partition pruning and the single-record view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions.textgeom import to_geojson
from mapshelf.operators.boxes import Box, query_boxes


#: Fixed value: the record of a view that found none.
NOTHING = '{"out_bound":1}'


def _any(conditions: list[str]) -> str:
    return "(" + " or ".join(conditions) + ")"


def range_query(features: DataFrame, mbr: str | Box, strict: bool = False, points: bool = False) -> DataFrame:
    """Features that intersect the box, touching included, each once.

    The comparisons on the flat box columns come first and reach the Parquet reader; the
    shape is looked at for the rows that pass. ``points=True`` promises point geometries,
    for which the box columns decide.
    """
    f = G.with_mbr(features)
    boxes = query_boxes(mbr, strict)
    near = f.where(_any([G.boxes_overlap(b) for b in boxes]))
    if points:
        return near.select(*features.columns)
    exact = _any([G.intersects_box("geom", b, G.MBR_COLUMNS) for b in boxes])
    return near.where(exact).select(*features.columns)


def prune_partitions(master: DataFrame, boxes: list[Box]) -> DataFrame:
    """Manifest rows of the partitions a query has to read."""
    return master.where(_any([G.boxes_overlap(b) for b in boxes]))


def in_partitions(indexed: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the named partitions. A list that is small enough to be broadcast also prunes the folders that are read."""
    return indexed.join(parts.select("part_id"), "part_id", "left_semi").select(*indexed.columns)


def indexed_range_query(indexed: DataFrame, master: DataFrame | None, mbr: str | Box,
                        strict: bool = False, points: bool = False) -> DataFrame:
    """Range query that opens only the partitions whose box meets the query."""
    f = indexed
    if master is not None:
        f = in_partitions(indexed, prune_partitions(master, query_boxes(mbr, strict)))
    return range_query(f, mbr, strict, points)


def attributes_json(df: DataFrame, names: list[str] | None = None, extents: bool = False) -> Column:
    """Attributes of a row as a JSON object without NULL fields."""
    names = G.attribute_columns(df) if names is None else names
    fields = [F.col(c) for c in names]
    if extents:
        fields.append(F.array(*G.MBR_COLUMNS).alias("extents"))
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd HH:mm:ss.S"})


def feature_json(df: DataFrame, names: list[str] | None = None) -> Column:
    """A GeoJSON feature."""
    return F.concat(F.lit('{"type":"Feature","properties":'), attributes_json(df, names),
                    F.lit(',"geometry":'), F.expr(to_geojson("geom")), F.lit("}"))


def view_feature(features: DataFrame, order: list[str], mbr: str | Box | None = None, fmt: str = "json",
                 extents: bool = False, strict: bool = False, attributes: list[str] | None = None) -> DataFrame:
    """One row ``record``: the first match by box and ``order``, or ``{"out_bound":1}``.

    Without a box it is the first record of all.
    """
    fmt = fmt.lower()
    if fmt not in ("json", "geojson"):
        raise ValueError(f"Unknown view format '{fmt}'")
    f = G.with_mbr(features)
    names = [c for c in G.attribute_columns(f) if c not in order] if attributes is None else attributes
    if mbr is None:
        hits = f.withColumn("_box", F.lit(0))
    else:
        boxes = query_boxes(mbr, strict)
        ranks = " ".join(f"when {G.intersects_box('geom', b, G.MBR_COLUMNS)} then {i}" for i, b in enumerate(boxes))
        near = f.where(_any([G.boxes_overlap(b) for b in boxes]))
        hits = near.withColumn("_box", F.expr(f"case {ranks} end")).where(F.col("_box").isNotNull())
    # Top one first, text last: only the chosen record is turned into JSON.
    one = hits.orderBy("_box", *order).limit(1)
    text = attributes_json(one, names, extents) if fmt == "json" else feature_json(one, names)
    found = one.agg(F.first(text).alias("record"))
    return found.select(F.coalesce("record", F.lit(NOTHING)).alias("record"))

"""Breaking large geometries into small ones, and the clean-up steps before drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G

SMALLEST_THRESHOLD = 5
DEFAULT_THRESHOLD = 100


def _ring_geometry(kind: str, vertices: str) -> str:
    return G.geometry(f"'{kind}'", f"array({G.part(repr(kind), f'array({vertices})')})")


def _chunks(ring: str, t: int) -> str:
    """Lines of ``t`` vertices in which neighbours share one vertex."""
    runs = f"sequence(0, int(floor((size({ring}) - 2) / {t - 1})))"
    return f"transform({runs}, _ch -> {_ring_geometry('LineString', f'slice({ring}, _ch * {t - 1} + 1, {t})')})"


def pieces(geom: str, threshold: int) -> str:
    """Array of the geometries that a geometry breaks into, in breadth-first order.

    What is within the threshold at one step comes before what had to be broken again: whole
    members, then rings (and chunks of member lines), then chunks of rings.
    """
    if threshold < SMALLEST_THRESHOLD:
        raise ValueError(f"Threshold {threshold} is too small. Minimum threshold is {SMALLEST_THRESHOLD}")
    t = threshold
    size = G.ring_points("_pm")
    collection = f"{geom}.kind in ({G.text_list(G.MULTI_KINDS)})"
    # A single line or polygon counts as its own only member, and as too large.
    large = f"filter({geom}.parts, _pm -> {size} > if({collection}, {t}, 0))"
    whole = (f"transform(filter({geom}.parts, _pm -> {collection} and {size} between 1 and {t}), "
             f"_pw -> {G.geometry('_pw.kind', 'array(_pw)')})")
    rings = f"transform(filter(_ps.rings, _pr -> size(_pr) <= {t}), _pr -> {_ring_geometry('LinearRing', '_pr')})"
    line = f"flatten(transform(_ps.rings, _pl -> {_chunks('_pl', t)}))"
    second = f"flatten(transform({large}, _ps -> if(_ps.kind = 'Polygon', {rings}, {line})))"
    third = (f"flatten(transform(filter({large}, _pt -> _pt.kind = 'Polygon'), _pt -> flatten("
             f"transform(filter(_pt.rings, _pu -> size(_pu) > {t}), _pu -> {_chunks('_pu', t)}))))")
    n = G.num_points(geom)
    none = f"cast(array() as array<{G.GEOM}>)"
    return (f"case when {n} = 0 then {none} "
            f"when {n} <= {t} or {geom}.kind in ('Point', 'Envelope') then array({geom}) "
            f"when {geom}.kind in ({G.text_list(G.KINDS)}) then concat({whole}, {second}, {third}) "
            f"else cast(raise_error(concat('Unexpected geometry type ', {geom}.kind)) as array<{G.GEOM}>) end")


def break_geometries(df: DataFrame, threshold: int = DEFAULT_THRESHOLD, position: str | None = None) -> DataFrame:
    """One row per piece; ``position`` names an optional column with the piece number."""
    others = [c for c in df.columns if c not in ("geom", *G.MBR_COLUMNS)]
    exploded = F.expr(f"posexplode({pieces('geom', threshold)}) AS (_pos, _piece)")
    out = df.select(*others, exploded)
    extra = [F.col("_pos").alias(position)] if position else []
    return out.select(*others, *extra, F.col("_piece").alias("geom"))


def strip_attributes(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in ("geom", *G.MBR_COLUMNS) if c in df.columns])


def drop_null_geometry(df: DataFrame) -> DataFrame:
    return df.where(F.col("geom").isNotNull())


def drop_empty_and_outside_map(df: DataFrame) -> DataFrame:
    """Keep geometries whose bounding box meets the Web Mercator map."""
    return G.with_mbr(df).where(G.boxes_overlap(G.MAP_BOX))


def viz_features(df: DataFrame, threshold: int = DEFAULT_THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Geometry-only rows for drawing."""
    broken = break_geometries(drop_null_geometry(df), threshold)
    return strip_attributes(drop_empty_and_outside_map(broken), keep)

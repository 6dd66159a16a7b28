"""Query boxes: parsing, wrapping around the world and splitting at the date line."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapshelf.functions.geometry import BOX

Box = tuple[float, float, float, float]


def parse_mbr(text: Column) -> Column:
    """``west,south,east,north`` to a box."""
    p = F.split(text, ",")
    return F.struct(*[F.trim(F.element_at(p, i + 1)).cast("double").alias(n)
                      for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))])


def _wrap(v: Column) -> Column:
    return v - F.lit(360.0) * F.floor((v + F.lit(180.0)) / F.lit(360.0)).cast("double")


def normalize_mbr(box: Column, strict: bool = False) -> Column:
    """One box, or two for a box across the date line (the eastern one first).

    Boxes at least as wide as the world become the whole range of longitudes. ``strict``
    does so only for wider ones, and a box of exactly 360 degrees from -180 then becomes
    a box without width.
    """
    width = box["xmax"] - box["xmin"]
    world = (width > 360.0) if strict else (width >= 360.0)
    x0 = F.when(world, F.lit(-180.0)).otherwise(_wrap(box["xmin"]))
    x1 = F.when(world, F.lit(180.0)).otherwise(_wrap(box["xmax"]))

    def made(a, b) -> Column:
        return F.struct(a.alias("xmin"), box["ymin"].alias("ymin"), b.alias("xmax"), box["ymax"].alias("ymax")).cast(BOX)

    split = F.array(made(x0, F.lit(180.0)), made(F.lit(-180.0), x1))
    return F.when(x0 > x1, split).otherwise(F.array(made(x0, x1)))


def query_boxes(mbr: str | Box, strict: bool = False) -> list[Box]:
    """The same for one box known when the query is built."""
    x0, y0, x1, y1 = [float(v) for v in (mbr.split(",") if isinstance(mbr, str) else mbr)]
    if x1 - x0 > 360.0 or (not strict and x1 - x0 >= 360.0):
        x0, x1 = -180.0, 180.0
    else:
        x0, x1 = [v - 360.0 * math.floor((v + 180.0) / 360.0) for v in (x0, x1)]
    if x0 > x1:
        return [(x0, y0, 180.0, y1), (-180.0, y0, x1, y1)]
    return [(x0, y0, x1, y1)]

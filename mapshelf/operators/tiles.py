"""Tile pyramid as data: features per tile and per pixel, levels 0 to 19.

Points are counted at the deepest level and rolled up. Other shapes are followed tile by tile: each segment goes through the columns of
a level and, in each, through the rows between its heights at the column's sides. That is the outline. A tile that no outline enters lies
wholly inside a polygon or outside; inside tiles are found next to the outline, as children of the outline tiles of the level above,
and only those are rows, so a polygon costs its outline on all levels and not its area. All tiles below an inside tile are inside too.

Counts of small shapes do not send these rows anywhere: shapes that lie near one another come to one task, which follows them and sends counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions.grid import interleave, mercator_x, mercator_y, tile_index
from mapshelf.operators import tile_walk
from mapshelf.session import materialize

LEVELS = 20
TILE_PIXELS = 256
BAND = 5
SMALL = 1 << 14         # tiles, by estimate, of the shapes of a key that are followed within a task
SMALL_ROWS = 64         # rows of such a key
NEAR_BITS = 20
_AREAS = "('Polygon', 'MultiPolygon', 'GeometryCollection')"


def to_mercator(geom: str) -> str:
    """Geometry in the unit square of the map, (0, 0) at the north-western corner."""
    moved = G.vertex(mercator_x("_tv.x"), mercator_y("_tv.y"))
    rings = f"transform(_tp.rings, _tr -> transform(_tr, _tv -> {moved}))"
    return G.geometry(f"{geom}.kind", f"transform({geom}.parts, _tp -> {G.part('_tp.kind', rings)})")


def _on_map(df: DataFrame) -> DataFrame:
    return G.with_mbr(df).where(G.boxes_overlap(G.MAP_BOX))


def _outline(df: DataFrame, levels: int, first: int, keep: tuple[str, ...]) -> DataFrame:
    """(keep, z, x, y, turns): the tiles that each segment goes through. ``turns`` is 1 where it is a polygon's and crosses the middle height of the row.

    The heights at a column's sides are computed once for both neighbours, so the crossings along a row of a closed ring are even.
    """
    rings = "transform(_op.rings, _or -> struct(_or AS ring, _op.kind = 'Polygon' AS area))"
    f = _on_map(df).selectExpr(*keep, f"explode(flatten(transform(geom.parts, _op -> {rings}))) AS r")
    f = f.selectExpr(*keep, "r.area", f"explode({G.segments_of_rings('array(r.ring)')}) AS seg")
    f = f.selectExpr(*keep, "area", *(f"{fn(f'seg.{a}{i}')} AS {u}{i}" for fn, a, u in ((mercator_x, "x", "u"), (mercator_y, "y", "v")) for i in (1, 2)))
    f = f.selectExpr("*", f"explode(sequence({first}, {levels - 1})) AS z").withColumn("n", F.expr("double(shiftleft(1L, z))"))
    f = f.selectExpr(*keep, "area", "z", "n", "u1 * n AS a1", "u2 * n AS a2", "v1 * n AS b1", "v2 * n AS b2",
                     f"explode(sequence({tile_index('least(u1, u2)', 'z')}, {tile_index('greatest(u1, u2)', 'z')})) AS x")
    low, high = "least(a1, a2)", "greatest(a1, a2)"
    f = f.selectExpr("*", f"if(x = 0, {low}, greatest({low}, double(x))) AS xa", f"if(x = n - 1, {high}, least({high}, double(x + 1))) AS xb")

    def height(at: str, else_: str) -> str:
        return f"case when a1 = a2 then {else_} when {at} = a1 then b1 when {at} = a2 then b2 else b1 + (b2 - b1) * (({at} - a1) / (a2 - a1)) end"
    f = f.selectExpr("*", f"{height('xa', 'b1')} AS ya", f"{height('xb', 'b2')} AS yb")
    row = lambda y: f"greatest(0L, least(bigint(n) - 1L, bigint(floor({y}))))"
    f = f.selectExpr("*", f"explode(sequence({row('least(ya, yb)')}, {row('greatest(ya, yb)')})) AS y")
    middle = "y + 0.5D"
    return f.selectExpr(*keep, "z", "x", "y", f"int(area and (ya <= {middle} and {middle} < yb or yb <= {middle} and {middle} < ya)) AS turns")


def assign_tiles(df: DataFrame, levels: int = LEVELS, keep: tuple[str, ...] = ("fid",), first: int = 0) -> DataFrame:
    """(keep, z, x, y) of every tile that the outline of a shape goes through, each once. ``keep`` tells features apart."""
    return _outline(df, levels, first, keep).select(*keep, "z", "x", "y").distinct()


def shape_tiles(df: DataFrame, levels: int = LEVELS, key: str | None = None) -> DataFrame:
    """(key, z, x, y, inside): the outline's tiles, and those that lie wholly inside a polygon while their parents do not.

    Without a ``key`` the rows of the table are told apart by their position, so it should be a stored one. Parts of a multi-polygon must not overlap.
    """
    if key is None:
        df, key = df.withColumn("_feature", F.monotonically_increasing_id()), "_feature"
    outline = _outline(df, levels, 0, (key,)).withColumn("met", F.lit(True))
    # Children of the outline's tiles of polygons; those that no outline enters are inside or outside as a whole.
    areas = df.where(f"geom.kind in {_AREAS}")
    above = _outline(areas, levels - 1, 0, (key,)).select(key, "z", "x", "y").distinct() if levels > 1 else None
    if above is not None:
        child = "array(struct(2 * x AS x, 2 * y AS y), struct(2 * x + 1 AS x, 2 * y AS y), struct(2 * x AS x, 2 * y + 1 AS y), struct(2 * x + 1 AS x, 2 * y + 1 AS y))"
        below = above.selectExpr(key, "z + 1 AS z", f"inline({child})").withColumn("turns", F.lit(0)).withColumn("met", F.lit(False))
        outline = outline.unionByName(below)
    tiles = outline.groupBy(key, "z", "x", "y").agg(F.sum("turns").alias("turns"), F.max("met").alias("met"))
    before = F.sum("turns").over(Window.partitionBy(key, "z", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tiles.withColumn("before", before).where("met or before % 2 = 1").selectExpr(key, "z", "x", "y", "not met AS inside")


def _with_rings(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, rings): the rings on the unit square, none for a shape off the map."""
    uv = "flatten(transform(_wr, _wv -> array(_wv.x, _wv.y)))"
    rings = f"flatten(transform({to_mercator('geom')}.parts, _wp -> transform(_wp.rings, _wr -> struct({uv} AS uv, _wp.kind = 'Polygon' AS area, geom.kind in {_AREAS} AS holds))))"
    return G.with_mbr(df).selectExpr(*keep, f"if({G.boxes_overlap(G.MAP_BOX)}, {rings}, null) AS rings")


def shape_counts(df: DataFrame, levels: int = LEVELS, key: str | None = None) -> DataFrame:
    """(z, x, y, cnt, inside) in parts that are still to be summed: the tiles of ``shape_tiles``, counted.

    Shapes are sent to tasks by their place and followed there. Rows of lines that share a key are counted each by itself, and what they have in common
    is found key by key and taken off. Keys of large shapes or very many rows, of polygons on several rows and of
    missing coordinates go through ``shape_tiles``, so no task holds one whole.
    """
    # No segment is longer than the box; only where that says too little are the segments added up.
    pieces = "aggregate(geom.parts, 0, (_cn, _cp) -> _cn + aggregate(_cp.rings, 0, (_cm, _cr) -> _cm + size(_cr)))"
    span = f"({mercator_x('xmax')} - {mercator_x('xmin')} + {mercator_y('ymin')} - {mercator_y('ymax')}) * {float(1 << levels)!r}D"
    way = lambda a: f"abs({a('_cs.$2')} - {a('_cs.$1')})".replace("$", "x" if a is mercator_x else "y")
    exact = f"aggregate({G.segments('geom')}, 0D, (_cl, _cs) -> _cl + ({way(mercator_x)} + {way(mercator_y)}) * {float(1 << levels)!r}D + {levels})"
    cost = f"if(exists({G.vertices_of('geom')}, _cv -> _cv.x is null or _cv.y is null or isnan(_cv.x) or isnan(_cv.y)), null, if(pieces * ({span} + {levels}) <= 512, pieces * ({span} + {levels}), {exact}))"
    boxes = [c for c in G.MBR_COLUMNS if c in df.columns]
    named = F.monotonically_increasing_id() if key is None else F.col(key)
    everything = df.select(named.alias("_key"), "geom", *boxes)
    f = _on_map(everything).withColumn("pieces", F.expr(pieces)).where("pieces > 0").withColumn("cost", F.expr(f"coalesce({cost}, double('inf'))"))

    def whole(some: DataFrame) -> DataFrame:
        return shape_tiles(some, levels, "_key").selectExpr("z", "x", "y", "bigint(not inside) AS cnt", "bigint(inside) AS inside")

    if key is None:
        parts = [whole(f.where(f"cost > {SMALL}"))]
        small = f.where(f"cost <= {SMALL}")
    else:
        sizes = f.groupBy("_key").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.expr(f"bool_or(geom.kind in {_AREAS})").alias("area"))
        large = materialize(sizes.where(f"n > {SMALL_ROWS} or cost > {SMALL} or n > 1 and area").select(F.col("_key").alias("_large")), "large-shapes")
        parts, small, match = [], everything, F.col("_key").eqNullSafe(F.col("_large"))
        if not large.isEmpty():
            parts.append(whole(f.join(large, match, "left_semi")))
            small = small.join(large, match, "left_anti")
        by_key = Window.partitionBy("_key")
        shared = small.withColumns({"n": F.count("*").over(by_key), "head": F.row_number().over(by_key.orderBy("_key")) == 1})
        parts.append(_with_rings(shared.where("n > 1"), "head").mapInArrow(tile_walk.repeats(levels), tile_walk.SCHEMA))
    corner = [f"coalesce(least({(1 << NEAR_BITS) - 1}D, greatest(0D, (get(get(get(geom.parts, 0).rings, 0), 0).{a} + {half}D) * {(1 << NEAR_BITS) / (2 * half)!r}D)), 0D)"
              for a, half in (("x", 180.0), ("y", 90.0))]
    near = small.withColumns({"near": F.expr(interleave(*(f"bigint({c})" for c in corner), NEAR_BITS)), "tie": F.xxhash64("_key")})
    near = near.repartitionByRange("near", "tie").sortWithinPartitions("near")
    return reduce(DataFrame.unionByName, [_with_rings(near).mapInArrow(tile_walk.counts(levels), tile_walk.SCHEMA), *parts])


def rollup_counts(deepest: DataFrame, level: int, band: int = BAND) -> DataFrame:
    """(z, x, y, cnt) of all levels from counts at ``level``.

    Each step aggregates at most ``band`` levels from the top level of the step before, so
    the features themselves are shuffled once and every later step reads counts only.
    """
    out, source, at = [], deepest.select("x", "y", "cnt"), level
    first = True
    while at >= 0:
        low = max(at - band + 1, 0)
        # Levels of this step; the level ``at`` itself was emitted by the step before.
        zs = list(range(low, at + 1 if first else at))
        if zs:
            wide = source.selectExpr("x", "y", "cnt", f"explode(sequence({zs[0]}, {zs[-1]})) AS z")
            summed = wide.selectExpr("z", f"shiftright(x, {at} - z) AS x", f"shiftright(y, {at} - z) AS y", "cnt")
            step = summed.groupBy("z", "x", "y").agg(F.sum("cnt").alias("cnt"))
            out.append(step)
            source = step.where(F.col("z") == low).select("x", "y", "cnt")
        if low == 0:
            break
        at, first = low, False
    return reduce(DataFrame.unionByName, out)


def point_tiles(df: DataFrame, level: int) -> DataFrame:
    """Tile of each point at one level; other kinds fail."""
    checked = "if(xmin = xmax and ymin = ymax, xmin, cast(raise_error('Not a point') as double))"
    return _on_map(df).withColumn("xmin", F.expr(checked)).selectExpr(
        f"{tile_index(mercator_x('xmin'), level)} AS x", f"{tile_index(mercator_y('ymin'), level)} AS y")


def tile_counts(df: DataFrame, levels: int = LEVELS, points: bool = False, key: str | None = None) -> DataFrame:
    """Features per tile. ``points=True`` promises that every geometry is a point: (z, x, y, cnt).

    Other shapes: (z, x, y, cnt, inside), ``cnt`` features whose outline goes through the tile and ``inside`` polygons that hold
    the tile but not its parent. A tile's features are its ``cnt`` and the ``inside`` of itself and all tiles above: ``tile_lookup``.
    """
    if points:
        deepest = point_tiles(df, levels - 1).groupBy("x", "y").agg(F.count("*").alias("cnt"))
        return rollup_counts(deepest, levels - 1)
    spots = tile_counts(df.where("geom.kind = 'Point'"), levels, points=True).withColumn("inside", F.lit(0).cast("long"))
    shapes = shape_counts(df.where("geom.kind <> 'Point'"), levels, key)
    both = spots.unionByName(shapes)
    return both.groupBy("z", "x", "y").agg(F.sum("cnt").alias("cnt"), F.sum("inside").alias("inside"))


def tile_raster(df: DataFrame, levels: int = LEVELS, px: int = TILE_PIXELS, first: int = 0, points: bool = True, key: str | None = None) -> DataFrame:
    """Features per pixel: (z, x, y, px, py, cnt), for points, or with ``points=False`` for lines.

    Pixels of level z are tiles of level z + log2(px), so the counts of points come from the roll-up, and a line has the pixels that it goes
    through. Other kinds fail: break polygons first, which gives their rings.
    """
    bits = px.bit_length() - 1
    if px != 1 << bits:
        raise ValueError("tile size must be a power of two")
    if points:
        deepest = point_tiles(df, levels - 1 + bits).groupBy("x", "y").agg(F.count("*").alias("cnt"))
        fine = rollup_counts(deepest, levels - 1 + bits).where(F.col("z") >= bits + first)
    else:
        if key is None:
            df, key = df.withColumn("_feature", F.monotonically_increasing_id()), "_feature"
        kinds = G.text_list(("Point", "MultiPoint", "LineString", "LinearRing", "MultiLineString"))
        known = f"if(geom.kind in ({kinds}), geom, cast(raise_error(concat('No raster of a ', geom.kind)) as {G.GEOM}))"
        walked = assign_tiles(df.withColumn("geom", F.expr(known)), levels + bits, (key,), bits + first)
        fine = walked.groupBy("z", "x", "y").agg(F.count("*").alias("cnt"))
    return fine.selectExpr(
        f"z - {bits} AS z", f"shiftright(x, {bits}) AS x", f"shiftright(y, {bits}) AS y",
        f"x & {px - 1}L AS px", f"y & {px - 1}L AS py", "cnt")


def write_pyramid(counts: DataFrame, path: str) -> None:
    """Tiles in one folder per level. Ranges of tiles go to tasks of even size, however full a
    level is, and the sorted files give a lookup tight row group statistics."""
    ranged = counts.repartitionByRange("z", "x", "y").sortWithinPartitions("z", "x", "y")
    ranged.write.mode("errorifexists").partitionBy("z").parquet(path)


def tile_lookup(pyramid: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """(z, x, y, cnt) of one tile; no row where it is empty. Polygons that hold a tile above count too."""
    own = (F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)
    if "inside" not in pyramid.columns:
        return pyramid.where(own)
    above = own
    for up in range(1, z + 1):
        above |= (F.col("z") == z - up) & (F.col("x") == x >> up) & (F.col("y") == y >> up)
    total = pyramid.where(above).agg(F.sum(F.when(own, F.col("cnt")).otherwise(0) + F.col("inside")).alias("cnt")).where("cnt > 0")
    return total.select(F.lit(z).alias("z"), F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), "cnt")


def tile_url(z: Column, x: Column, y: Column, extension: str = ".png") -> Column:
    return F.format_string("tile-%d-%d-%d" + extension, z, x, y)

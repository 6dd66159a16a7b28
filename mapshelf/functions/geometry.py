"""The geometry column and the functions over it.

A geometry is ``struct<kind, parts: array<struct<kind, rings: array<array<struct<x,y>>>>>>``.
A point, line or ring has one part with one ring; a polygon has one part whose first ring is
the shell and whose other rings are holes; multi-geometries and collections have one part per
member. An empty geometry has no parts and a missing one is NULL.

The functions take SQL expression text (usually column names) and return SQL expression text
for ``F.expr`` and ``selectExpr``. Text is parsed in one step, where the same expression built
from column objects costs thousands of calls into the JVM. Geometry arguments must be column or
lambda names; ``let`` binds anything else.

Array lambdas are interpreted by Spark, so callers test the flat bounding box columns first
and reach the functions here only for the rows that survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double>"
PART = f"struct<kind:string,rings:array<array<{VERTEX}>>>"
GEOM = f"struct<kind:string,parts:array<{PART}>>"
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"

MBR_COLUMNS = ("xmin", "ymin", "xmax", "ymax")
SYSTEM_COLUMNS = ("geom", *MBR_COLUMNS, "part_id", "zkey", "n_points", "n_bytes")

KINDS = (
    "Point", "LineString", "LinearRing", "Polygon", "Envelope",
    "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection",
)
MULTI_KINDS = ("MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")

# The box of the Web Mercator map.
MAP_BOX = (-180.0, -85.0511287798066, 180.0, 85.0511287798066)


def num(value) -> str:
    """Text stays; a number becomes a double literal."""
    return value if isinstance(value, str) else f"{float(value)!r}D"


def text_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# ---------------------------------------------------------------- constructors

def vertex(x, y) -> str:
    return f"named_struct('x', double({num(x)}), 'y', double({num(y)}))"


def part(kind: str, rings: str) -> str:
    return f"named_struct('kind', {kind}, 'rings', {rings})"


def geometry(kind: str, parts: str) -> str:
    return f"named_struct('kind', {kind}, 'parts', {parts})"


def point(x, y) -> str:
    return geometry("'Point'", f"array({part(repr('Point'), f'array(array({vertex(x, y)}))')})")


def line(vertices: str, kind: str = "LineString") -> str:
    return geometry(f"'{kind}'", f"array({part(repr(kind), f'array({vertices})')})")


def polygon(rings: str) -> str:
    return geometry("'Polygon'", f"array({part(repr('Polygon'), rings)})")


def multipoint(vertices: str) -> str:
    return geometry("'MultiPoint'", f"transform({vertices}, _mp -> {part(repr('Point'), 'array(array(_mp))')})")


def ring_of(*corners) -> str:
    """A ring through the given (x, y) corners."""
    return "array(" + ", ".join(vertex(x, y) for x, y in corners) + ")"


def box_polygon(xmin, ymin, xmax, ymax) -> str:
    """A closed ring that starts at the lower left corner and goes counter-clockwise."""
    ring = ring_of((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))
    return polygon(f"array({ring})")


# ---------------------------------------------------------------- measures

def rings_of(geom: str) -> str:
    return f"flatten(transform({geom}.parts, _rp -> _rp.rings))"


def vertices_of(geom: str) -> str:
    return f"flatten({rings_of(geom)})"


def _first_vertex(geom: str) -> str:
    return f"get(get(get({geom}.parts, 0).rings, 0), 0)"


def ring_points(part_name: str) -> str:
    return f"aggregate({part_name}.rings, 0, (_na, _nr) -> _na + size(_nr))"


def num_points(geom: str) -> str:
    """All vertices, with the closing vertex of rings."""
    return (f"bigint(case when {geom}.kind = 'Point' then if(get({geom}.parts, 0) is null, 0, 1) "
            f"when {geom} is not null then aggregate({geom}.parts, 0, (_ng, _np) -> _ng + {ring_points('_np')}) end)")


def is_empty(geom: str) -> str:
    return f"({num_points(geom)} = 0)"


def _bound(geom: str, axis: str, pick: str) -> str:
    # A point needs no array of coordinates.
    return (f"case when {geom}.kind = 'Point' then {_first_vertex(geom)}.{axis} "
            f"else {pick}(transform({vertices_of(geom)}, _bv -> _bv.{axis})) end")


def xmin(geom: str) -> str:
    return _bound(geom, "x", "array_min")


def ymin(geom: str) -> str:
    return _bound(geom, "y", "array_min")


def xmax(geom: str) -> str:
    return _bound(geom, "x", "array_max")


def ymax(geom: str) -> str:
    return _bound(geom, "y", "array_max")


def mbr(geom: str) -> str:
    """Closed bounding box; its fields are NULL for a missing or empty geometry."""
    return (f"named_struct('xmin', {xmin(geom)}, 'ymin', {ymin(geom)}, "
            f"'xmax', {xmax(geom)}, 'ymax', {ymax(geom)})")


def side_lengths(geom: str) -> str:
    return f"named_struct('width', {xmax(geom)} - {xmin(geom)}, 'height', {ymax(geom)} - {ymin(geom)})"


def with_mbr(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Add the four flat bounding box columns unless the table already has them."""
    if all(c in df.columns for c in MBR_COLUMNS):
        return df
    return df.withColumns({c: F.expr(f(geom)) for c, f in zip(MBR_COLUMNS, (xmin, ymin, xmax, ymax))})


def attribute_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SYSTEM_COLUMNS]


# ---------------------------------------------------------------- predicates

def segments_of_rings(rings: str) -> str:
    """Consecutive vertex pairs; a lone vertex gives one segment of length zero."""
    pair = "named_struct('x1', _sa.x, 'y1', _sa.y, 'x2', _sb.x, 'y2', _sb.y)"
    return (f"flatten(transform({rings}, _sr -> zip_with("
            f"if(size(_sr) > 1, slice(_sr, 1, size(_sr) - 1), _sr), "
            f"if(size(_sr) > 1, slice(_sr, 2, size(_sr) - 1), _sr), (_sa, _sb) -> {pair})))")


def segments(geom: str) -> str:
    return segments_of_rings(rings_of(geom))


def turn(ax, ay, bx, by, cx, cy) -> str:
    """Positive when c lies to the left of the directed line from a to b."""
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def _turn_of(s: str, x: str, y: str) -> str:
    return turn(f"{s}.x1", f"{s}.y1", f"{s}.x2", f"{s}.y2", x, y)


def segments_touch(s: str, t: str) -> str:
    """Closed intersection of two segments, either of which may have length zero.

    Two segments meet exactly when their boxes overlap and neither lies strictly on one side
    of the other's line; on a shared line the box test alone decides.
    """
    def overlap(a: str) -> str:
        return (f"least({s}.{a}1, {s}.{a}2) <= greatest({t}.{a}1, {t}.{a}2) "
                f"and least({t}.{a}1, {t}.{a}2) <= greatest({s}.{a}1, {s}.{a}2)")

    def straddles(p: str, q: str) -> str:
        return (f"signum({_turn_of(p, f'{q}.x1', f'{q}.y1')}) "
                f"* signum({_turn_of(p, f'{q}.x2', f'{q}.y2')}) <= 0")

    return f"({overlap('x')} and {overlap('y')} and {straddles(s, t)} and {straddles(t, s)})"


def segment_touches_box(s: str, bx0, by0, bx1, by1) -> str:
    """Closed test: the boxes overlap and the box corners are not all strictly on one side."""
    bx0, by0, bx1, by1 = num(bx0), num(by0), num(bx1), num(by1)
    corners = ", ".join(_turn_of(s, cx, cy) for cx in (bx0, bx1) for cy in (by0, by1))
    return (f"(least({s}.x1, {s}.x2) <= {bx1} and greatest({s}.x1, {s}.x2) >= {bx0} "
            f"and least({s}.y1, {s}.y2) <= {by1} and greatest({s}.y1, {s}.y2) >= {by0} "
            f"and least({corners}) <= 0 and greatest({corners}) >= 0)")


def crosses_ray(s: str, x: str, y: str) -> str:
    """Does the ray from (x, y) to the right cross the segment? Half open in y."""
    return (f"(({s}.y1 <= {y} and {s}.y2 > {y} and {_turn_of(s, x, y)} > 0) "
            f"or ({s}.y2 <= {y} and {s}.y1 > {y} and {_turn_of(s, x, y)} < 0))")


def strictly_inside(x, y, edges: str) -> str:
    """Crossing parity; points on an edge must have been accepted before."""
    return f"(size(filter({edges}, _si -> {crosses_ray('_si', num(x), num(y))})) % 2 = 1)"


def polygon_parts(geom: str) -> str:
    return f"filter({geom}.parts, _pp -> _pp.kind = 'Polygon')"


def _some_vertex_inside(outer: str, inner: str) -> str:
    """Is the first vertex of any part of ``inner`` inside a polygon part of ``outer``?"""
    inside = strictly_inside("_vi.x", "_vi.y", segments_of_rings("_vp.rings"))
    return (f"exists({polygon_parts(outer)}, _vp -> exists("
            f"transform({inner}.parts, _vq -> get(get(_vq.rings, 0), 0)), _vi -> {inside}))")


def intersects(a: str, b: str) -> str:
    """Closed intersection of two geometries; NULL and empty never intersect anything."""
    touch = f"exists({segments(a)}, _ia -> exists({segments(b)}, _ib -> {segments_touch('_ia', '_ib')}))"
    return f"coalesce({touch} or {_some_vertex_inside(a, b)} or {_some_vertex_inside(b, a)}, false)"


def boxes_overlap(box, bounds=MBR_COLUMNS) -> str:
    """Closed overlap of the flat bounding box columns (or ``bounds``) with ``box``."""
    x0, y0, x1, y1 = bounds
    bx0, by0, bx1, by1 = [num(v) for v in box]
    return f"({x0} <= {bx1} and {x1} >= {bx0} and {y0} <= {by1} and {y1} >= {by0})"


def intersects_box(geom: str, box, bounds=None) -> str:
    """Closed intersection with an axis-aligned box: bounding box first, then the shape."""
    x0, y0, x1, y1 = bounds or (xmin(geom), ymin(geom), xmax(geom), ymax(geom))
    bx0, by0, bx1, by1 = [num(v) for v in box]
    near = boxes_overlap((bx0, by0, bx1, by1), (x0, y0, x1, y1))
    within = f"({x0} >= {bx0} and {x1} <= {bx1} and {y0} >= {by0} and {y1} <= {by1})"
    edge = f"exists({segments(geom)}, _eb -> {segment_touches_box('_eb', bx0, by0, bx1, by1)})"
    covers = f"exists({polygon_parts(geom)}, _cb -> {strictly_inside(bx0, by0, segments_of_rings('_cb.rings'))})"
    return f"coalesce({near} and ({geom}.kind = 'Point' or {within} or {edge} or {covers}), false)"


def kind_code(geom: str) -> str:
    """Number of the kind in ``KINDS``, from 1; other kinds are 0."""
    whens = " ".join(f"when '{k}' then {i + 1}" for i, k in enumerate(KINDS))
    return f"case {geom}.kind {whens} when null then null else if({geom} is null, null, 0) end"

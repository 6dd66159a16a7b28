"""Geometry to and from text: WKT, GeoJSON and KML, as SQL expression text."""

from __future__ import annotations

from mapshelf.functions.geometry import GEOM, PART, let

# WKT keyword, geometry kind, kind of each part.
WKT_KINDS = [
    ("POINT", "Point", "Point"),
    ("LINESTRING", "LineString", "LineString"),
    ("LINEARRING", "LinearRing", "LinearRing"),
    ("POLYGON", "Polygon", "Polygon"),
    ("MULTIPOINT", "MultiPoint", "Point"),
    ("MULTILINESTRING", "MultiLineString", "LineString"),
    ("MULTIPOLYGON", "MultiPolygon", "Polygon"),
    ("GEOMETRYCOLLECTION", "GeometryCollection", None),
]

# Bracket groups of depth one, two and three, and a WKT member with its body.
_FLAT = r"\([^()]*\)"
_NEST = rf"\((?:[\s,]*{_FLAT})+\s*\)"
_DEEP = rf"\((?:[\s,]*{_NEST})+\s*\)"
_TAG = r"\s*(?:ZM|Z|M)?\s*"
_MEMBER = (
    rf"(?:MULTIPOLYGON{_TAG}{_DEEP}"
    rf"|(?:MULTILINESTRING|MULTIPOINT|POLYGON){_TAG}{_NEST}"
    rf"|(?:MULTIPOINT|LINESTRING|LINEARRING|POINT){_TAG}{_FLAT})")
_NUMBER = r"[-+0-9.E]+"

_COORDS = "array<array<array<array<double>>>>"
_NO_PARTS = f"cast(array() as array<{PART}>)"


def _raw(pattern: str) -> str:
    """A text literal in which backslashes stand for themselves."""
    return f"r'{pattern}'"


def _pick(word: str, position: int) -> str:
    whens = " ".join(f"when '{row[0]}' then '{row[position]}'" for row in WKT_KINDS if row[position])
    return f"case {word} {whens} end"


def _parts(coords: str, kind: str) -> str:
    """Four-level coordinate arrays (part, ring, vertex, ordinate) to geometry parts."""
    return (f"transform({coords}, _cp -> named_struct('kind', {kind}, 'rings', transform(_cp, _cr -> "
            f"transform(_cr, _cv -> named_struct('x', get(_cv, 0), 'y', get(_cv, 1))))))")


def _deepen(kind: str, body: str) -> str:
    """Coordinate JSON of any simple kind to the four-level arrays of ``_parts``."""
    return (
        f"case when {kind} = 'Point' then from_json(concat('[[[', {body}, ']]]'), '{_COORDS}') "
        f"when {kind} in ('LineString', 'LinearRing') then from_json(concat('[[', {body}, ']]'), '{_COORDS}') "
        f"when {kind} = 'Polygon' then from_json(concat('[', {body}, ']'), '{_COORDS}') "
        f"when {kind} = 'MultiPoint' then transform(from_json({body}, 'array<array<double>>'), _dv -> array(array(_dv))) "
        f"when {kind} = 'MultiLineString' then transform(from_json({body}, 'array<array<array<double>>>'), _dr -> array(_dr)) "
        f"when {kind} = 'MultiPolygon' then from_json({body}, '{_COORDS}') end")


def from_wkt(text: str) -> str:
    """Parse WKT of the seven kinds and one level of collections; blank text gives NULL.

    Text that names no known kind, or names one without a readable body, fails the job.
    """
    upper = f"upper(trim(regexp_replace({text}, {_raw(r'^\s*SRID=\d+;')}, '')))"
    bare = f"regexp_replace(_wm, {_raw(r'^[A-Z\s]+')}, '')"
    flat = f"regexp_replace({bare}, {_raw('[()]')}, '')"
    word = f"regexp_extract(_wm, {_raw(r'^([A-Z]+?)\s*(?:ZM|Z|M)?\s*\(')}, 1)"
    # One bracket per vertex; MULTIPOINT may bracket its points already, and a lone point keeps
    # one bracket pair less than a list of vertices.
    body = f"case {word} when 'POINT' then {flat} when 'MULTIPOINT' then concat('(', {flat}, ')') else {bare} end"
    coords = (f"trim(translate(regexp_replace({body}, "
              f"{_raw(rf'({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*')}, '[$1,$2]'), '()', '[]'))")
    member = let(f"named_struct('kind', {_pick(word, 1)}, 'part', {_pick(word, 2)}, 'coords', {coords})", "_wc",
                 _parts(_deepen("_wc.kind", "_wc.coords"), "_wc.part"))
    keyword = f"regexp_extract(_wu, {_raw(r'^([A-Z]+?)(?:ZM|Z|M)?(?:\s|\(|$)')}, 1)"
    scanned = let(upper, "_wu", (
        f"named_struct('known', {_pick(keyword, 1)}, 'members', regexp_extract_all(_wu, {_raw(f'({_MEMBER})')}, 1), "
        f"'blank', contains(_wu, 'EMPTY'))"))
    made = let(scanned, "_ws", (
        f"case when _ws.known is null or (size(_ws.members) = 0 and not _ws.blank) "
        f"then cast(raise_error(concat('Unreadable WKT: ', {text})) as {GEOM}) "
        f"else cast(named_struct('kind', _ws.known, 'parts', "
        f"flatten(transform(_ws.members, _wm -> {member}))) as {GEOM}) end"))
    # A member that does not parse has no parts, and a missing ordinate is NULL.
    broken = ("_wg.parts is null or exists(_wg.parts, _wp -> coalesce(exists(_wp.rings, _wr -> coalesce(exists(_wr, "
              "_wv -> _wv.x is null or _wv.y is null), true)), true))")
    checked = let(made, "_wg", f"case when {broken} then cast(raise_error(concat('Unreadable WKT: ', {text})) as {GEOM}) else _wg end")
    return f"case when trim({text}) <> '' then {checked} end"


def _xy_list(ring: str, between: str, join: str) -> str:
    return (f"array_join(transform({ring}, _xv -> concat(string(_xv.x), '{between}', string(_xv.y))), '{join}')")


def to_wkt(geom: str) -> str:
    """WKT without blanks around brackets and commas."""
    rings = f"concat('(', array_join(transform(_tp.rings, _tr -> concat('(', {_xy_list('_tr', ' ', ',')}, ')')), ','), ')')"
    flat = f"concat('(', {_xy_list('get(_tp.rings, 0)', ' ', ',')}, ')')"
    body = f"if(_tp.kind = 'Polygon', {rings}, {flat})"
    joined = f"concat('(', array_join(transform(_tg.parts, _tp -> {body}), ','), ')')"
    members = f"concat('(', array_join(transform(_tg.parts, _tp -> concat(upper(_tp.kind), {body})), ','), ')')"
    return let(geom, "_tg", (
        f"case when _tg is null then cast(null as string) "
        f"when size(_tg.parts) = 0 then concat(upper(_tg.kind), ' EMPTY') "
        f"when _tg.kind = 'GeometryCollection' then concat(upper(_tg.kind), {members}) "
        f"when startswith(_tg.kind, 'Multi') then concat(upper(_tg.kind), {joined}) "
        f"else concat(upper(_tg.kind), get(transform(_tg.parts, _tp -> {body}), 0)) end"))


def from_geojson(geom_json: str) -> str:
    """Parse a GeoJSON geometry held as JSON text; JSON null gives NULL."""
    simple = "struct<type:string,coordinates:string>"
    g = f"from_json({geom_json}, 'struct<type:string,coordinates:string,geometries:string>')"
    single = _parts(_deepen("_gj.type", "_gj.coordinates"), "regexp_replace(_gj.type, '^Multi', '')")
    many = (f"flatten(transform(from_json(_gj.geometries, 'array<{simple}>'), _gm -> "
            f"{_parts(_deepen('_gm.type', '_gm.coordinates'), 'regexp_replace(_gm.type, ' + repr('^Multi') + ', ' + repr('') + ')')}))")
    return let(g, "_gj", (
        f"case when _gj.type is not null then cast(named_struct('kind', _gj.type, 'parts', "
        f"case when _gj.type = 'GeometryCollection' then {many} "
        f"when _gj.coordinates = '[]' then {_NO_PARTS} else {single} end) as {GEOM}) end"))


def to_geojson(geom: str) -> str:
    """GeoJSON geometry text; rings become line strings and NULL becomes JSON null."""
    def typed(kind: str, coords: str) -> str:
        name = f"if({kind} = 'LinearRing', 'LineString', {kind})"
        return f"concat('{{\"type\":\"', {name}, '\",\"coordinates\":', {coords}, '}}')"

    def coords(ring: str) -> str:
        return (f"concat('[', array_join(transform({ring}, _jv -> "
                f"concat('[', string(_jv.x), ',', string(_jv.y), ']')), ','), ']')")

    lone = "get(get(_jp.rings, 0), 0)"
    body = (f"case when _jp.kind = 'Point' then concat('[', string({lone}.x), ',', string({lone}.y), ']') "
            f"when _jp.kind = 'Polygon' then concat('[', array_join(transform(_jp.rings, _jr -> {coords('_jr')}), ','), ']') "
            f"else {coords('get(_jp.rings, 0)')} end")
    bodies = f"transform(_jg.parts, _jp -> {body})"
    members = f"transform(_jg.parts, _jp -> {typed('_jp.kind', body)})"
    listed = f"concat('[', array_join({bodies}, ','), ']')"
    return let(geom, "_jg", (
        f"case when _jg is null then 'null' "
        f"when _jg.kind = 'GeometryCollection' then concat('{{\"type\":\"GeometryCollection\",\"geometries\":[', "
        f"array_join({members}, ','), ']}}') "
        f"when size(_jg.parts) = 0 then {typed('_jg.kind', repr('[]'))} "
        f"when startswith(_jg.kind, 'Multi') then {typed('_jg.kind', listed)} "
        f"else {typed('_jg.kind', f'get({bodies}, 0)')} end"))


def to_kml(geom: str) -> str:
    """KML geometry element."""
    def coords(ring: str) -> str:
        return f"concat('<coordinates>', {_xy_list(ring, ',', ' ')}, '</coordinates>')"

    first = "get(_kp.rings, 0)"
    inner = (f"array_join(transform(slice(_kp.rings, 2, greatest(size(_kp.rings) - 1, 0)), _kr -> "
             f"concat('<innerBoundaryIs><LinearRing>', {coords('_kr')}, '</LinearRing></innerBoundaryIs>')), '')")
    element = (
        f"case _kp.kind when 'Point' then concat('<Point>', {coords(first)}, '</Point>') "
        f"when 'Polygon' then concat('<Polygon><outerBoundaryIs><LinearRing>', {coords(first)}, "
        f"'</LinearRing></outerBoundaryIs>', {inner}, '</Polygon>') "
        f"when 'LinearRing' then concat('<LinearRing>', {coords(first)}, '</LinearRing>') "
        f"else concat('<LineString>', {coords(first)}, '</LineString>') end")
    elements = f"transform(_kg.parts, _kp -> {element})"
    return let(geom, "_kg", (
        f"case when size(_kg.parts) = 1 then get({elements}, 0) "
        f"when _kg is not null then concat('<MultiGeometry>', array_join({elements}, ''), '</MultiGeometry>') end"))


def xml_escape(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{plain}', '{entity}')"
    return text

"""Queries over the catalog and over submissions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mapshelf.functions import links as L
from mapshelf.functions import textgeom as X
from mapshelf.operators import catalog as C
from mapshelf.operators import options as O
from workloads import derive as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


_WITH = f"WITH {D.CATALOG} "
_TAGS = "array_join(tags, ',') AS tags"
_TAGS_SQL = "array_to_string(tags, ',') AS tags"


# ---------------------------------------------------------------- lists and lookups

@query("catalog_list", _WITH + f"""SELECT _id, name, size, num_features, num_points, geometry_type, format, {_TAGS_SQL}
FROM catalog WHERE status = 'published'""")
def catalog_list(spark, sf):
    return C.list_published(D.catalog(spark, sf)).selectExpr(
        "_id", "name", "size", "num_features", "num_points", "geometry_type", "format", _TAGS)


@query("catalog_list_all", _WITH + "SELECT _id, num_features, CAST(NULL AS VARCHAR) AS no_such FROM catalog")
def catalog_list_all(spark, sf):
    return C.list_datasets(D.catalog(spark, sf), attrs=["num_features", "no_such"])


@query("catalog_find", _WITH + "SELECT _id, name, title, size FROM catalog WHERE _id = lpad('2A', 24, '0')")
def catalog_find(spark, sf):
    return C.find(D.catalog(spark, sf), "2A".rjust(24, "0"), ("status", "description")).select("_id", "name", "title", "size")


@query("catalog_find_name", _WITH + """SELECT _id, name, status FROM catalog
WHERE source = (SELECT source FROM documents WHERE doc_id = 17) AND doc_id = 17""")
def catalog_find_name(spark, sf):
    name = C.find(D.catalog(spark, sf), "11".rjust(24, "0")).first()["name"]
    return C.find_by_name(D.catalog(spark, sf), name).select("_id", "name", "status")


@query("catalog_find_id_then_name", _WITH + """SELECT _id, CAST(NULL AS VARCHAR) AS status, 'id' AS found FROM catalog WHERE doc_id = 5
UNION ALL SELECT _id, status, 'name' FROM catalog WHERE source || '/' || doc_id = (SELECT min(source) FROM documents WHERE doc_id = 3) || '/3'""")
def catalog_find_id_then_name(spark, sf):
    """The key is once an id and once a name."""
    c = D.catalog(spark, sf)
    by_id = C.find_id_then_name(c, "5".rjust(24, "0")).select("_id", "status", F.lit("id").alias("found"))
    names = c.where(F.col("_id") == "3".rjust(24, "0")).select(F.col("name").alias("k")).first()
    by_name = C.find_id_then_name(c, names.k).select("_id", "status", F.lit("name").alias("found"))
    return by_id.unionByName(by_name)


@query("catalog_search", _WITH + """SELECT _id, name FROM catalog
WHERE contains(lower(name || ' ' || description || ' ' || array_to_string(tags, ',')), 'license')""")
def catalog_search(spark, sf):
    return C.search(D.catalog(spark, sf), " LICENSE ").select("_id", "name")


@query("catalog_search_category", _WITH + """SELECT _id, name FROM catalog
WHERE contains(lower(name || ' ' || description || ' ' || array_to_string(tags, ',')), 'the')
  AND (name = 'src7' OR starts_with(name, 'src7/'))""")
def catalog_search_category(spark, sf):
    return C.search(D.catalog(spark, sf), "THE", "src7").select("_id", "name")


@query("catalog_suggest", _WITH + """SELECT _id, name FROM catalog
WHERE contains(lower(name), 'the') OR contains(lower(description), 'the') ORDER BY _id LIMIT 10""")
def catalog_suggest(spark, sf):
    return C.suggest(D.catalog(spark, sf), "The").select("_id", "name")


@query("category_prefixes", _WITH + """SELECT DISTINCT split_part(trim(name), '/', 1) AS prefix FROM catalog
WHERE length(trim(name)) > 0 AND split_part(trim(name), '/', 1) NOT IN ('Riverside', 'OSM2015', 'NE', 'TIGER2018')""")
def category_prefixes(spark, sf):
    return C.category_prefixes(D.catalog(spark, sf))


@query("catalog_json", _WITH + """, p AS (SELECT * FROM catalog WHERE status = 'published')
SELECT 0 AS part, CAST(NULL AS VARCHAR) AS sort_key, '{"datasets":[' AS line
UNION ALL SELECT CASE WHEN _id = (SELECT min(_id) FROM p) THEN 1 ELSE 2 END, _id, CASE WHEN _id = (SELECT min(_id) FROM p) THEN '' ELSE ',' END || '{"_id":"' || _id || '","name":"' || name
  || '","size":' || size || CASE WHEN num_points IS NULL THEN '' ELSE ',"num_points":' || num_points END
  || ',"tags":["' || lang || '","' || source || '"]}' FROM p
UNION ALL SELECT 3, NULL, ']}'""")
def catalog_json(spark, sf):
    rows = D.catalog(spark, sf).where(F.col("status") == "published").select("_id", "name", "size", "num_points", "tags")
    return C.to_catalog_json(rows).select("part", "sort_key", "line")


@query("catalog_json_listed", _WITH + """, p AS (SELECT *, row_number() OVER (ORDER BY num_features DESC, _id) AS nth FROM catalog WHERE status = 'published')
SELECT 0 AS part, 0 AS nth, '{"datasets":[' AS line
UNION ALL SELECT CASE WHEN nth = 1 THEN 1 ELSE 2 END, nth, CASE WHEN nth = 1 THEN '' ELSE ',' END || '{"_id":"' || _id || '","num_features":' || num_features || '}' FROM p
UNION ALL SELECT 3, (SELECT count(*) FROM p) + 1, ']}'""")
def catalog_json_listed(spark, sf):
    """The document in the order of the published list."""
    rows = C.list_published(D.catalog(spark, sf), ["num_features"]).select("_id", "num_features")
    lines = C.to_catalog_json(rows, order=C.LIST_ORDER)
    nth = F.row_number().over(Window.orderBy("part", "sort_key")) - 1
    return lines.select("part", nth.cast("long").alias("nth"), "line")


# ---------------------------------------------------------------- changes

_NOW = "timestamp'2030-01-01 00:00:00'"
_STAMP = "date_format(modifiedAt, 'yyyy-MM-dd HH:mm:ss') AS modified"
_STAMP_SQL = "strftime(modifiedAt, '%Y-%m-%d %H:%M:%S') AS modified"


@query("catalog_update", _WITH + """SELECT _id, CASE WHEN doc_id % 3 = 0 AND n_new THEN 'new ' || doc_id ELSE title END AS title, status,
  CASE WHEN doc_id % 3 = 0 THEN '2030-01-01 00:00:00' ELSE strftime(modifiedAt, '%Y-%m-%d %H:%M:%S') END AS modified
FROM (SELECT *, doc_id % 2 = 0 AS n_new FROM catalog)""")
def catalog_update(spark, sf):
    d = D.table(spark, sf, "documents").where(F.col("doc_id") % 3 == 0)
    changes = d.select(F.lpad(F.hex("doc_id"), 24, "0").alias("_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(
        F.lit("new "), F.col("doc_id").cast("string"))).alias("title"))
    return C.apply_updates(D.catalog(spark, sf).drop("description"), changes, F.expr(_NOW)).selectExpr("_id", "title", "status", _STAMP)


@query("catalog_publish", _WITH + f"""SELECT _id, CASE WHEN status = 'ready' THEN 'published' ELSE status END AS status, {_STAMP_SQL} FROM catalog""")
def catalog_publish(spark, sf):
    return C.publish(D.catalog(spark, sf)).selectExpr("_id", "status", _STAMP)


@query("catalog_publish_one", _WITH + """SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN doc_id = 1 THEN 'published' ELSE status END AS status FROM catalog) GROUP BY status""")
def catalog_publish_one(spark, sf):
    one = C.publish(D.catalog(spark, sf), "1".rjust(24, "0"), F.expr(_NOW))
    return one.groupBy("status").agg(F.count("*").alias("n"))


@query("catalog_status_many", _WITH + """SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN status = 'created' THEN 'downloaded' ELSE status END AS status FROM catalog) GROUP BY status""")
def catalog_status_many(spark, sf):
    return C.with_status_changed(D.catalog(spark, sf), "created", "downloaded").groupBy("status").agg(F.count("*").alias("n"))


@query("catalog_delete", _WITH + "SELECT _id, name FROM catalog WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def catalog_delete(spark, sf):
    gone = D.table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.lpad(F.hex("doc_id"), 24, "0").alias("_id"))
    return C.remove(D.catalog(spark, sf), gone).select("_id", "name")


@query("last_modified", _WITH + """SELECT strftime(max(modifiedAt), '%Y-%m-%d %H:%M:%S') AS last_modified FROM catalog WHERE status = 'published'""")
def last_modified(spark, sf):
    return C.last_modified(D.catalog(spark, sf), "published").select(
        F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"))


@query("changed_since", _WITH + f"""SELECT _id, {_STAMP_SQL} FROM catalog WHERE modifiedAt >= TIMESTAMP '2024-01-01 02:00:00'""")
def changed_since(spark, sf):
    return C.changed_since(D.catalog(spark, sf), F.lit("2024-01-01 02:00:00").cast("timestamp")).selectExpr("_id", _STAMP)


@query("list_is_current", _WITH + """SELECT max(modifiedAt) < TIMESTAMP '2024-01-01 02:00:00' AS unchanged FROM catalog WHERE status = 'published'""")
def list_is_current(spark, sf):
    return C.list_is_current(D.catalog(spark, sf), F.lit("2024-01-01 02:00:00").cast("timestamp"))


@query("pending", _WITH + "SELECT _id, status FROM catalog WHERE status = 'created'")
def pending(spark, sf):
    return C.select_pending(D.catalog(spark, sf)).select("_id", "status")


@query("pending_reset", _WITH + "SELECT _id, 'summarized' AS status FROM catalog WHERE doc_id = 9")
def pending_reset(spark, sf):
    return C.select_pending(D.catalog(spark, sf), "9".rjust(24, "0"), "summarized").select("_id", "status")


@query("remaining_stages", _WITH + """SELECT _id, CASE status
    WHEN 'created' THEN 'downloaded,decompressed,summarized,indexed,ready' WHEN 'downloaded' THEN 'decompressed,summarized,indexed,ready'
    WHEN 'decompressed' THEN 'summarized,indexed,ready' WHEN 'summarized' THEN 'indexed,ready' WHEN 'indexed' THEN 'ready' END AS stages,
  CASE WHEN status IN ('ready', 'published') THEN status || '-error' ELSE 'ready' END AS result,
  CASE WHEN status IN ('ready', 'published') THEN 'Cannot process dataset in status ''' || status || '''' END AS error FROM catalog""")
def remaining_stages(spark, sf):
    return C.remaining_stages(D.catalog(spark, sf)).select("_id", F.array_join("stages", ",").alias("stages"), "result", "error")


@query("remaining_stages_unpacked", _WITH + """SELECT _id, CASE status
    WHEN 'created' THEN 'downloaded,summarized,indexed,ready' WHEN 'downloaded' THEN 'summarized,indexed,ready'
    WHEN 'decompressed' THEN 'summarized,indexed,ready' WHEN 'summarized' THEN 'indexed,ready' WHEN 'indexed' THEN 'ready' END AS stages
FROM catalog""")
def remaining_stages_unpacked(spark, sf):
    return C.remaining_stages(D.catalog(spark, sf), decompress=False).select("_id", F.array_join("stages", ",").alias("stages"))


# ---------------------------------------------------------------- derived columns

@query("separate_index", _WITH + """SELECT _id, CASE WHEN num_features <> 0 THEN coalesce(num_points, 0) // num_features END AS per_feature,
  coalesce(CASE WHEN num_features <> 0 THEN coalesce(num_points, 0) // num_features END >= 100, false) AS separate FROM catalog""")
def separate_index(spark, sf):
    return D.catalog(spark, sf).select(
        "_id", C.points_per_feature(F.col("num_points"), F.col("num_features")).alias("per_feature"),
        C.needs_separate_index(F.col("num_points"), F.col("num_features")).alias("separate"))


@query("visualization_choice", _WITH + """SELECT _id, CASE WHEN size < 1048576 THEN 'Vector' ELSE 'Tile' END AS type,
  CASE WHEN size < 1048576 THEN '/dynamic/download.cgi/' || index_path || '.geojson'
       ELSE '/dynamic/visualize.cgi/' || name || '/plot.zip/tile-{z}-{x}-{y}.png' END AS url FROM catalog""")
def visualization_choice(spark, sf):
    v = C.choose_visualization(F.col("size"), F.col("index_path"), F.concat("name", F.lit("/plot.zip")))
    return D.catalog(spark, sf).select("_id", v.alias("v")).select("_id", "v.*")


_DETAIL = """details AS (SELECT _id AS d_id, doc_id AS d, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 90 AS DOUBLE) END AS ext,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Detail ' || doc_id END AS d_title FROM catalog WHERE doc_id % 2 = 0)"""


@query("merge_details", _WITH + f""", {_DETAIL} SELECT _id, coalesce(nullif(d_title, ''), title) AS title, ext AS west, ext + 1 AS east,
  CASE WHEN d IS NOT NULL THEN 'http://x/' || d END AS download_url FROM catalog LEFT JOIN details ON _id = d_id""")
def merge_details(spark, sf):
    key = F.conv(F.ltrim("_id"), 16, 10).cast("long")
    ext = F.when(key % 4 == 0, (key % 90).cast("double"))
    c = D.catalog(spark, sf).select("_id", "title")
    details = D.catalog(spark, sf).where(key % 2 == 0).select(
        "_id", F.when(ext.isNotNull(), F.array(ext, F.lit(0.0), ext + 1, F.lit(1.0))).alias("extent"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Detail "), key.cast("string"))).alias("title"),
        F.concat(F.lit("http://x/"), key.cast("string")).alias("download_url"))
    m = C.merge_details(c, details)
    return m.select("_id", "title", F.get("extent", F.lit(0)).alias("west"), F.get("extent", F.lit(2)).alias("east"), "download_url")


@query("resolve_extent", """WITH d AS (SELECT doc_id, CAST(doc_id % 100 AS DOUBLE) AS v,
  CASE WHEN doc_id % 3 = 0 THEN 'Riverside/' ELSE 'x/' END || doc_id AS name FROM documents)
SELECT name, CASE WHEN doc_id % 4 = 0 THEN v WHEN doc_id % 4 = 1 THEN v + 1 WHEN doc_id % 3 = 0 THEN -117.7::DOUBLE END AS west,
  CASE WHEN doc_id % 4 = 0 THEN v + 3 WHEN doc_id % 4 = 1 THEN v + 4 WHEN doc_id % 3 = 0 THEN 34.1::DOUBLE END AS north FROM d""")
def resolve_extent(spark, sf):
    """List form, named corners, an incomplete list, and nothing."""
    key = F.col("doc_id")
    v = (key % 100).cast("double")
    d = D.table(spark, sf, "documents").select(
        F.concat(F.when(key % 3 == 0, F.lit("Riverside/")).otherwise(F.lit("x/")), key.cast("string")).alias("name"),
        F.when(key % 4 == 0, F.array(v, v + 1, v + 2, v + 3)).when(key % 4 == 2, F.array(v, v)).alias("extent"),
        F.when(key % 4 == 1, F.struct((v + 1).alias("minLon"), (v + 2).alias("minLat"), (v + 3).alias("maxLon"),
                                      (v + 4).alias("maxLat"))).alias("corners"))
    e = C.resolve_extent(F.col("extent"), F.col("corners"), F.col("name"))
    return d.select("name", F.get(e, F.lit(0)).alias("west"), F.get(e, F.lit(3)).alias("north"))


@query("extent_polygon", """WITH d AS (SELECT doc_id, CAST(doc_id % 100 AS DOUBLE) AS v FROM documents)
SELECT doc_id, 'POLYGON((' || v || ' ' || v + 1 || ',' || v + 2 || ' ' || v + 1 || ',' || v + 2 || ' ' || v + 3 || ',' || v || ' ' || v + 3
  || ',' || v || ' ' || v + 1 || '))' AS wkt FROM d""")
def extent_polygon(spark, sf):
    v = (F.col("doc_id") % 100).cast("double")
    d = D.table(spark, sf, "documents").select("doc_id", F.array(v, v + 1, v + 2, v + 3).alias("extent"))
    return d.select("doc_id", C.extent_to_polygon("extent").alias("geom")).selectExpr("doc_id", f"{X.to_wkt('geom')} AS wkt")


# ---------------------------------------------------------------- submissions, options and links

@query("submission_rows", f"""WITH {D.SUBMISSIONS}
SELECT 'p/' || page_id AS name, CASE WHEN page_id % 7 = 0 THEN 'my own' ELSE 'CC0' END AS license,
  CASE WHEN page_id % 3 <> 0 THEN link END AS download_url, CASE WHEN page_id % 3 = 0 THEN link || ' | ' || url END AS download_urls,
  'a|b' || page_id AS tags, 'created' AS status,
  concat_ws(chr(10), CASE WHEN page_id % 5 = 2 THEN 'iformat=geojson' WHEN page_id % 5 = 3 THEN 'iformat=wkt(' || CASE WHEN page_id % 2 = 0 THEN '3' ELSE '0' END || ')'
      WHEN page_id % 5 = 0 THEN 'iformat=point(lon,lat)' WHEN page_id % 5 = 1 THEN 'iformat=point(0,1)' END,
    CASE WHEN page_id % 4 = 0 THEN 'separator=;' END, CASE WHEN page_id % 2 = 0 THEN 'skipheader=true' END) AS options
FROM submissions""")
def submission_rows(spark, sf):
    return C.submission_to_catalog(D.submissions(spark, sf)).select(
        "name", "license", "download_url", F.array_join("download_urls", " | ").alias("download_urls"),
        F.array_join("tags", "|").alias("tags"), "status", O.options_text(F.col("options")).alias("options"))


@query("options_map", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'iformat=point(' || page_id || ',2)' || chr(10) || 'separator= ' || chr(10) || 'skipheader=true'
  WHEN 1 THEN 'iformat=wkt(' || page_id || ')' || chr(10) || 'separator=;' ELSE 'a=' || page_id || chr(10) || 'b=x' END AS options FROM pages""")
def options_map(spark, sf):
    """Options as command line text, as a list, and as a map."""
    key = F.col("page_id").cast("string")
    kind = F.col("page_id") % 3
    p = D.table(spark, sf, "pages").select(
        "page_id", F.when(kind == 0, F.concat(F.lit("iformat:point("), key, F.lit(",2) -skipheader 'separator: '"))).alias("text"),
        F.when(kind == 1, F.array(F.concat(F.lit("iformat:wkt("), key, F.lit(")")), F.lit("separator:;"))).alias("items"),
        F.when(kind == 2, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), key)).alias("mapping"))
    return p.select("page_id", O.options_text(O.normalize_options(F.col("text"), F.col("items"), F.col("mapping"))).alias("options"))


@query("merged_options", """SELECT page_id, 'a=run' || chr(10) || 'iformat=' || CASE WHEN page_id % 2 = 0 THEN 'wkt(' || page_id || ')' ELSE 'point' END
  || chr(10) || 'separator=' || CASE WHEN page_id % 3 = 0 THEN ';' ELSE ',' END AS options FROM pages""")
def merged_options(spark, sf):
    run = F.create_map(*[F.lit(v) for v in ("iformat", "point", "separator", ",", "a", "run")])
    key = F.col("page_id")
    own = F.map_filter(F.create_map(
        F.lit("iformat"), F.when(key % 2 == 0, F.concat(F.lit("wkt("), key.cast("string"), F.lit(")"))),
        F.lit("separator"), F.when(key % 3 == 0, F.lit(";"))), lambda k, v: v.isNotNull())
    return D.table(spark, sf, "pages").select("page_id", O.options_text(O.merge_options(run, own)).alias("options"))


@query("clean_links", f"""WITH {D.SUBMISSIONS}, extra AS (SELECT page_id, link FROM submissions UNION ALL
  SELECT 1000000 + page_id, CASE page_id % 3 WHEN 0 THEN 'https://drive.google.com/nothing/' || page_id WHEN 1 THEN 'https://onedrive.live.com/x' || page_id
    ELSE 'https://dropbox.com/?' || page_id END FROM pages)
SELECT page_id, CASE WHEN link LIKE '%drive.google.com%' THEN CASE WHEN link LIKE '%id=%' THEN 'https://docs.google.com/uc?export=download&id=ID' || page_id
      WHEN link LIKE '%file/d/%' THEN 'https://docs.google.com/uc?export=download&id=F' || page_id END
    WHEN link LIKE '%onedrive%' THEN CASE WHEN link LIKE '%file/d/%' THEN 'https://onedrive.live.com/download?cid=O' || page_id END
    WHEN link LIKE '%dropbox%' THEN CASE WHEN link LIKE '%/s/%' THEN 'https://www.dropbox.com/s/k' || page_id || '/data.zip?dl=1' END
    ELSE link END AS url,
  CASE WHEN page_id >= 1000000 THEN 'Cannot parse link: ' || link END AS error FROM extra""")
def clean_links(spark, sf):
    good = D.submissions(spark, sf).select("page_id", "link")
    key = F.col("page_id")
    bad = D.table(spark, sf, "pages").select((key + 1000000).alias("page_id"), F.concat(
        F.when(key % 3 == 0, F.lit("https://drive.google.com/nothing/")).when(key % 3 == 1, F.lit("https://onedrive.live.com/x"))
        .otherwise(F.lit("https://dropbox.com/?")), key.cast("string")).alias("link"))
    return good.unionByName(bad).select("page_id", L.direct_download_url(F.col("link")).alias("d")).select("page_id", "d.*")


@query("link_filenames_unique", """WITH d AS (SELECT page_id, page_id % 7 AS dataset, regexp_replace(url, '[?].*', '') AS url, regexp_extract(rtrim(regexp_replace(url, '[?].*', ''), '/'), '[^/]+$') AS plain FROM pages),
u AS (SELECT *, row_number() OVER (PARTITION BY dataset, plain ORDER BY url) - 1 AS nth FROM (SELECT DISTINCT dataset, url, plain FROM d))
SELECT page_id, CASE WHEN nth = 0 THEN plain ELSE regexp_extract(plain, '^(.+?)((?:\\.[^.]*)?)$', 1) || '-' || nth || '-' || substr(md5(url), 1, 12) || regexp_extract(plain, '^(.+?)((?:\\.[^.]*)?)$', 2) END AS filename,
  CAST(NULL AS VARCHAR) AS error FROM d JOIN u USING (dataset, url, plain)""")
def link_filenames_unique(spark, sf):
    """No two links of a dataset have one name."""
    p = D.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 7).alias("dataset"), F.regexp_replace("url", "[?].*", "").alias("url"))
    return L.unique_filenames(p, "dataset").select("page_id", "filename", "error")


@query("link_filenames", """WITH d AS (SELECT page_id, regexp_replace(url, '[?].*', '') AS base FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'data ' || page_id || '.csv' WHEN 3 THEN NULL ELSE regexp_extract(rtrim(base, '/'), '[^/]+$') END AS filename,
  CASE WHEN page_id % 4 = 3 THEN 'Unsupported protocol for URL: s3://b/' || page_id END AS error FROM d""")
def link_filenames(spark, sf):
    """Name from the header, from the link, and links of an unknown protocol."""
    key = F.col("page_id")
    p = D.table(spark, sf, "pages").select(
        "page_id", F.when(key % 4 == 3, F.concat(F.lit("s3://b/"), key.cast("string")))
        .otherwise(F.regexp_replace("url", "[?].*", "")).alias("url"),
        F.when(key % 4 == 0, F.concat(F.lit("attachment; filename=\"data "), key.cast("string"), F.lit(".csv\""))).alias("header"))
    return p.select("page_id", L.filename_of(F.col("url"), F.col("header")).alias("f")).select("page_id", "f.*")

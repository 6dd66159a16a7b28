"""Catalog of datasets: submissions, lookups, lists, search and changes.

Every operator takes and returns DataFrames. ``CatalogTable`` keeps a catalog in a folder of
Parquet versions; a change writes a new version and readers take the last finished one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.operators.documents import json_document

CATALOG_SCHEMA = (
    "_id string, name string, title string, description string, author string, email string, "
    "project_homepage string, license string, format string, download_urls array<string>, "
    "tags array<string>, status string, modifiedAt timestamp, size long, num_features long, "
    "num_points long, geometry_type string, extent array<double>, avg_sidelength array<double>, "
    "attributes array<struct<name:string,type:string>>, index_path string, "
    "visualization struct<type:string,url:string>, options map<string,string>")

# Names, order and limits that results must share.
STAGES = ["created", "downloaded", "decompressed", "summarized", "indexed", "ready"]
LIST_ATTRIBUTES = ["_id", "name", "description", "size", "num_features", "num_points",
                   "geometry_type", "format", "tags"]
NAV_TAGS = ["Riverside", "OSM2015", "NE", "TIGER2018"]
HOME_PREFIX = "Riverside/"
HOME_EXTENT = [-117.7, 33.4, -114.1, 34.1]
FLATTEN_THRESHOLD = 100
VECTOR_LIMIT = 1048576
SUGGESTIONS = 10


# ---------------------------------------------------------------- submissions

def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def submission_options(df: DataFrame) -> Column:
    """Reader options of a submission row."""
    pt = F.concat(F.lit("point("), F.coalesce(_given(F.col("x_column")), F.lit("0")), F.lit(","),
                  F.coalesce(_given(F.col("y_column")), F.lit("1")), F.lit(")"))
    wkt = F.concat(F.lit("wkt("), F.coalesce(_given(F.col("wkt_column")), F.lit("0")), F.lit(")"))
    iformat = (F.when(F.col("format") != "csv", F.col("format"))
               .when(F.col("geometry_type") == "point", pt)
               .when(F.col("geometry_type") == "wkt", wkt))
    pairs = F.array(
        F.struct(F.lit("iformat").alias("key"), iformat.alias("value")),
        F.struct(F.lit("separator").alias("key"), _given(F.col("delimiter")).alias("value")),
        F.struct(F.lit("skipheader").alias("key"),
                 F.when(F.col("skipheader").isNotNull(), F.lit("true")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _tag_list(tags: Column) -> Column:
    """Tags between commas; empty ones at the end do not count, and nothing but commas is no list."""
    kept = F.regexp_replace(tags, ",+$", "")
    return F.when((tags == "") | (kept != ""), F.split(kept, ","))


def submission_to_catalog(df: DataFrame) -> DataFrame:
    """Form rows to new catalog rows in status ``created``."""
    urls = F.transform(F.split(F.trim(F.regexp_replace("urls", r"[\t\r\n ]+$|^[\t\r\n ]+", "")),
                               r"\s*[\r\n]+\s*"), lambda u: F.trim(u))
    return df.select(
        "title", "description", "name", "author", "email", "project_homepage", "format",
        F.when(F.col("license") == "Other", F.col("license_other")).otherwise(F.col("license")).alias("license"),
        F.when(F.size(urls) == 1, F.get(urls, F.lit(0))).alias("download_url"),
        F.when(F.size(urls) > 1, urls).alias("download_urls"),
        _tag_list(F.col("tags")).alias("tags"), F.lit("created").alias("status"),
        submission_options(df).alias("options"))


# ---------------------------------------------------------------- lookups and lists

def list_datasets(catalog: DataFrame, status: str | None = None,
                  attrs: list[str] | None = None) -> DataFrame:
    """Largest datasets first; ``_id`` is always kept and unknown attributes are NULL."""
    rows = catalog if status is None else catalog.where(F.col("status") == status)
    rows = rows.orderBy(F.col("num_features").desc_nulls_last(), "_id")
    if attrs is None:
        return rows
    wanted = list(dict.fromkeys(["_id", *attrs]))
    return rows.select(*[F.col(a) if a in catalog.columns else F.lit(None).cast("string").alias(a)
                         for a in wanted])


def list_published(catalog: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    return list_datasets(catalog, "published", LIST_ATTRIBUTES if attrs is None else attrs)


def find(catalog: DataFrame, dataset_id: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    return catalog.where(F.col("_id") == dataset_id).drop(*exclude).limit(1)


def find_by_name(catalog: DataFrame, name: str) -> DataFrame:
    """First dataset of this name in id order."""
    return catalog.where(F.col("name") == name).orderBy("_id").limit(1)


def find_id_then_name(catalog: DataFrame, key: str) -> DataFrame:
    """By id without ``status``, else by name with it."""
    by_id = (F.col("_id") == key)
    rows = catalog.where(by_id | (F.col("name") == key)).withColumn("_by_name", (~by_id).cast("int"))
    rows = rows.withColumn("status", F.when(F.col("_by_name") == 1, F.col("status")))
    return rows.orderBy("_by_name", "_id").limit(1).drop("_by_name")


def last_modified(catalog: DataFrame, status: str | None = None) -> DataFrame:
    """Newest change; NULL for an empty selection."""
    rows = catalog if status is None else catalog.where(F.col("status") == status)
    return rows.agg(F.max("modifiedAt").alias("last_modified"))


def changed_since(catalog: DataFrame, since: Column) -> DataFrame:
    """Rows a client with a copy from ``since`` has to fetch again."""
    return catalog.where(F.col("modifiedAt") >= since)


def list_is_current(catalog: DataFrame, since: Column) -> DataFrame:
    """One row ``unchanged``: is a client's copy of the published list from ``since`` still good?"""
    return last_modified(catalog, "published").select((F.col("last_modified") < since).alias("unchanged"))


def select_pending(catalog: DataFrame, dataset_id: str | None = None, reset: str | None = None) -> DataFrame:
    """Datasets to process: one by id, optionally put into a status, or all in ``created``."""
    if dataset_id is None:
        return catalog.where(F.col("status") == "created")
    one = catalog.where(F.col("_id") == dataset_id)
    return one if reset is None else one.withColumn("status", F.lit(reset))


def remaining_stages(catalog: DataFrame, decompress: bool = True) -> DataFrame:
    """``stages`` still to run as an array of reached statuses, and the ``result`` status.

    Datasets that cannot be processed have NULL stages, an ``error`` text and their status
    with ``-error`` added.
    """
    order = F.array(*[F.lit(s) for s in STAGES])
    at = F.array_position(order, F.col("status")).cast("int")
    todo = F.slice(order, at + 1, F.greatest(F.lit(len(STAGES)) - at, F.lit(0)))
    if not decompress:
        todo = F.filter(todo, lambda s: s != "decompressed")
    known = F.coalesce((at > 0) & (F.col("status") != "ready"), F.lit(False))
    return catalog.select(
        "*", F.when(known, todo).alias("stages"),
        F.when(known, F.lit("ready")).otherwise(F.concat("status", F.lit("-error"))).alias("result"),
        F.when(~known, F.concat(F.lit("Cannot process dataset in status '"), "status", F.lit("'"))).alias("error"))


#: The order of ``list_datasets`` as an ascending key: most features first, unknown numbers last.
LIST_ORDER = "struct(-num_features IS NULL AS unknown, -num_features AS fewer, _id)"


def to_catalog_json(catalog: DataFrame, single: bool = False, order: str = "_id") -> DataFrame:
    """Lines of the document ``{"datasets":[...]}`` or ``{"dataset":{...}}``.

    ``order`` is SQL text of an ascending key; ``LIST_ORDER`` keeps that of the lists.
    """
    body = catalog.select(F.expr(order).alias("sort_key"), F.to_json(F.struct(*catalog.columns)).alias("line"))
    head, tail = ('{"dataset":', "}") if single else ('{"datasets":[', "]}")
    return json_document(body, head, tail)


# ---------------------------------------------------------------- search

def _text(c: str, df: DataFrame) -> Column:
    """Lower-case text of a column; a list of tags is joined with commas."""
    col = F.col(c)
    if df.schema[c].dataType.typeName() == "array":
        col = F.array_join(col, ",")
    return F.lower(F.coalesce(col, F.lit("")))


def in_category(name: Column, tag: str) -> Column:
    return F.coalesce((name == tag) | F.startswith(name, F.lit(tag + "/")), F.lit(False))


def search(catalog: DataFrame, query: str = "", category: str = "") -> DataFrame:
    """Text anywhere in name, description and tags, and category by name prefix."""
    q = (query or "").lower().strip()
    rows = catalog
    if q:
        words = F.concat_ws(" ", *[_text(c, catalog) for c in ("name", "description", "tags")])
        rows = rows.where(F.contains(words, F.lit(q)))
    if category:
        rows = rows.where(in_category(F.col("name"), category))
    return rows


def suggest(catalog: DataFrame, query: str, k: int = SUGGESTIONS, order: str = "_id") -> DataFrame:
    """First ``k`` datasets, in catalog order, with the text in name or description."""
    q = (query or "").lower().strip()
    if not q:
        return catalog.where(F.lit(False))
    hit = F.contains(_text("name", catalog), F.lit(q)) | F.contains(_text("description", catalog), F.lit(q))
    return catalog.where(hit).orderBy(order).limit(k)


def category_prefixes(catalog: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Distinct text before the first slash of the names, without the fixed navigation tags."""
    name = F.trim(F.col("name"))
    prefix = F.split_part(name, F.lit("/"), F.lit(1))
    rows = catalog.where(F.length(name) > 0).select(prefix.alias("prefix"))
    return rows.where(~F.col("prefix").isin(NAV_TAGS if exclude is None else exclude)).distinct().orderBy("prefix")


def merge_details(listed: DataFrame, details: DataFrame) -> DataFrame:
    """List rows overlaid by the details that are present."""
    fields = [c for c in ("extent", "download_url", "visualization", "title", "author") if c in details.columns]
    right = details.select("_id", *[F.col(c).alias("_new_" + c) for c in fields])

    def pick(c: str) -> Column:
        new = F.col("_new_" + c)
        if details.schema[c].dataType.typeName() == "string":
            new = _given(new)
        return F.coalesce(new, F.col(c)) if c in listed.columns else new

    merged = listed.join(right, "_id", "left")
    out = {c: pick(c) for c in fields}
    return merged.withColumns(out).select(*dict.fromkeys([*listed.columns, *fields]))


def resolve_extent(extent: Column, corners: Column | None, name: Column) -> Column:
    """Four numbers from the list form, else the named corners, else the home box by name."""
    numbers = [F.get(extent, F.lit(i)) for i in range(4)]
    if corners is not None:
        numbers = [F.coalesce(n, corners[k]) for n, k in zip(numbers, ("minLon", "minLat", "maxLon", "maxLat"))]
    whole = numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull() & numbers[3].isNotNull()
    home = F.array(*[F.lit(v) for v in HOME_EXTENT])
    return F.when(whole, F.array(*numbers)).when(F.startswith(name, F.lit(HOME_PREFIX)), home)


def extent_to_polygon(extent: str) -> Column:
    """The rectangle of a named extent column."""
    box = G.box_polygon(*[f"get({extent}, {i})" for i in range(4)])
    return F.expr(f"if(size({extent}) >= 4, {box}, null)")


# ---------------------------------------------------------------- derived columns

def points_per_feature(num_points: Column, num_features: Column) -> Column:
    """Whole-number ratio; missing points count as 0 and no features give NULL."""
    n = F.coalesce(num_features, F.lit(0))
    return F.when(n != 0, F.floor(F.coalesce(num_points, F.lit(0)) / F.nullif(n, F.lit(0))).cast("long"))


def needs_separate_index(num_points: Column, num_features: Column, override: Column | None = None,
                         threshold: int = FLATTEN_THRESHOLD) -> Column:
    computed = F.coalesce(points_per_feature(num_points, num_features) >= threshold, F.lit(False))
    return computed if override is None else F.coalesce(override, computed)


def choose_visualization(size: Column, index_path: Column, plot_path: Column, extension: str = ".png") -> Column:
    """Small datasets are drawn as one vector layer, others from tiles."""
    small = F.coalesce(size, F.lit(0)) < VECTOR_LIMIT
    vector = F.concat(F.lit("/dynamic/download.cgi/"), index_path, F.lit(".geojson"))
    tiles = F.concat(F.lit("/dynamic/visualize.cgi/"), plot_path, F.lit("/tile-{z}-{x}-{y}" + extension))
    return F.struct(F.when(small, F.lit("Vector")).otherwise(F.lit("Tile")).alias("type"),
                    F.when(small, vector).otherwise(tiles).alias("url"))


# ---------------------------------------------------------------- changes

def apply_updates(catalog: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Set the supplied fields by ``_id`` and stamp ``modifiedAt``.

    A field counts as supplied when its column exists in ``changes`` and the value there is
    not NULL, or its name is in the row's array ``_supplied``, which lets a change clear a field. Ids that the catalog
    lacks are ignored.
    """
    now = F.current_timestamp() if now is None else now
    fields = [c for c in changes.columns if c not in ("_id", "modifiedAt") and c in catalog.columns]
    named = F.col("_supplied") if "_supplied" in changes.columns else F.array().cast("array<string>")
    right = changes.select("_id", F.lit(True).alias("_hit"), named.alias("_named"), *[F.col(c).alias("_new_" + c) for c in fields])
    merged = catalog.join(right, "_id", "left")
    out = {c: F.when(F.coalesce(F.array_contains("_named", c), F.lit(False)), F.col("_new_" + c)).otherwise(
        F.coalesce(F.col("_new_" + c), F.col(c))) for c in fields}
    out["modifiedAt"] = F.when(F.col("_hit"), now).otherwise(F.col("modifiedAt"))
    return merged.withColumns(out).select(*catalog.columns)


def remove(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("_id"), "_id", "left_anti").select(*catalog.columns)


def with_status_changed(catalog: DataFrame, old: str, new: str) -> DataFrame:
    """Bulk status change; ``modifiedAt`` stays."""
    return catalog.withColumn("status", F.when(F.col("status") == old, F.lit(new)).otherwise(F.col("status")))


def publish(catalog: DataFrame, dataset_id: str | None = None, now: Column | None = None) -> DataFrame:
    """All ``ready`` datasets, or one dataset whatever its status."""
    if dataset_id is None:
        return with_status_changed(catalog, "ready", "published")
    hit = F.col("_id") == dataset_id
    now = F.current_timestamp() if now is None else now
    return catalog.withColumns({
        "status": F.when(hit, F.lit("published")).otherwise(F.col("status")),
        "modifiedAt": F.when(hit, now).otherwise(F.col("modifiedAt"))})


class CatalogTable:
    """A catalog kept as numbered Parquet versions below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root, jvm.org.apache.hadoop.fs.Path

    def _folders(self) -> list[int]:
        """Numbers of all version folders, finished or not."""
        fs, root, _ = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit())

    def _versions(self) -> list[int]:
        fs, _, path = self._fs()
        return [n for n in self._folders() if fs.exists(path(f"{self.path}/v-{n}/_SUCCESS"))]

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return self.spark.read.schema(CATALOG_SCHEMA).parquet(f"{self.path}/v-{versions[-1]}")

    def replace(self, rows: DataFrame) -> None:
        """Write under a name of its own, then rename to the next version.

        What a write that died has left takes no part. Of two writers that race, the rename of one fails. The version
        before stays for readers that are still at it; older ones go.
        """
        fs, _, path = self._fs()
        before = self._folders()
        draft, target = f"{self.path}/draft-{uuid.uuid4().hex}", f"{self.path}/v-{before[-1] + 1 if before else 0}"
        _to_catalog_schema(rows).write.mode("errorifexists").parquet(draft)
        if fs.exists(path(target)) or not fs.rename(path(draft), path(target)):
            raise OSError(f"Another writer has made '{target}'")
        kept = self._versions()[-2:]
        for n in self._folders():
            if n < kept[0]:
                fs.delete(path(f"{self.path}/v-{n}"), True)

    def insert(self, rows: DataFrame, id_seed: str = "name") -> None:
        """Append rows with new ids and the time of insertion."""
        made = F.substring(F.md5(F.concat_ws(":", F.uuid(), F.col(id_seed))), 1, 24)
        rows = rows.withColumns({"_id": made, "modifiedAt": F.current_timestamp()})
        self.replace(self.read().unionByName(_to_catalog_schema(rows)))

    def update(self, changes: DataFrame) -> None:
        self.replace(apply_updates(self.read(), changes))

    def delete(self, dataset_id: str) -> bool:
        """Remove one dataset and say whether it was there."""
        rows = self.read()
        if rows.where(F.col("_id") == dataset_id).isEmpty():
            return False
        self.replace(rows.where(F.col("_id") != dataset_id))
        return True

    def update_status_many(self, old: str, new: str) -> int:
        """Bulk status change; the number of changed rows."""
        rows = self.read()
        changed = rows.where(F.col("status") == old).count()
        if changed:
            self.replace(with_status_changed(rows, old, new))
        return changed


def _to_catalog_schema(rows: DataFrame) -> DataFrame:
    """Catalog columns in order; missing ones are NULL and one ``download_url`` becomes a list."""
    from pyspark.sql.types import StructType
    if "download_url" in rows.columns:
        single = F.when(F.col("download_url").isNotNull(), F.array("download_url"))
        both = F.coalesce(F.col("download_urls"), single) if "download_urls" in rows.columns else single
        rows = rows.withColumn("download_urls", both)
    schema = StructType.fromDDL(CATALOG_SCHEMA)
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

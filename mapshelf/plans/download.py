"""Download of a dataset or a part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.operators.indexing import indexed_input, read_index, read_master
from mapshelf.operators.regions import region_query
from mapshelf.operators.sinks import write_features
from mapshelf.operators.boxes import query_boxes
from mapshelf.operators.catalog import find_by_name
from mapshelf.operators.spatial_filter import NOTHING, in_partitions, indexed_range_query, prune_partitions, view_feature


def select_features(spark: SparkSession, index_path: str, mbr: str | None = None,
                    regions: DataFrame | None = None, region: str | None = None, order: str = "position",
                    key: str | None = None, points: bool = False) -> DataFrame:
    """Rows of an indexed dataset: all, in a box, or in a named region.

    A region wins over a box; ``order`` is the column of their places, of which the last counts where codes repeat. ``key`` names the unique column that region queries need for
    shapes other than points.
    """
    indexed = read_index(spark, index_path)
    if region is not None:
        master = read_master(spark, index_path)
        # The partition boxes are matched with the region like any other features.
        boxes = master.where("xmin is not null").selectExpr("part_id", f"{G.box_polygon(*G.MBR_COLUMNS)} AS geom")
        rows = in_partitions(indexed, region_query(boxes, regions, region, order, "part_id"))
        found = region_query(rows, regions, region, order, key or "fid", points=points)
    elif mbr is not None:
        found = indexed_range_query(indexed, read_master(spark, index_path), mbr, points=points)
    else:
        found = indexed
    return indexed_input(found).drop("part_id", *G.MBR_COLUMNS)


def is_current(spark: SparkSession, index_path: str, copied_at: Column) -> DataFrame:
    """One row ``unchanged``: is a whole-dataset copy made at ``copied_at`` as new as the index?"""
    written = spark.read.parquet(f"{index_path}/master").select("_metadata.file_modification_time")
    return written.agg((copied_at >= F.max("file_modification_time")).alias("unchanged"))


def download(spark: SparkSession, index_path: str, target: str, fmt: str, mbr: str | None = None,
             regions: DataFrame | None = None, region: str | None = None, order: str = "position", sep: str = ",",
             key: str | None = None, points: bool = False, bounded: bool = False) -> None:
    """Select, then write in the named format."""
    rows = select_features(spark, index_path, mbr, regions, region, order, key, points)
    write_features(rows, target, fmt, points=points, sep=sep, key=key, bounded=bounded)


def _indexed_dataset(catalog: DataFrame, base: str, name: str) -> tuple[str, bool, str]:
    """Index folder, whether it holds points, and the separator, as the catalog row of a dataset has them."""
    row = find_by_name(catalog, name).first()
    if row is None or not row["index_path"]:
        raise KeyError(f"No indexed dataset '{name}'")
    return f"{base.rstrip('/')}/{row['index_path']}", row["geometry_type"] == "Point", (row["options"] or {}).get("separator", ",")


def download_by_name(spark: SparkSession, catalog: DataFrame, base: str, name: str, target: str, fmt: str, **selection) -> None:
    """Download of a catalogued dataset; index, kind of geometry and separator come from its row."""
    index, points, sep = _indexed_dataset(catalog, base, name)
    download(spark, index, target, fmt, sep=sep, points=points, **selection)


#: Partitions that a view reads at first, how many times more it reads each time that it finds nothing, and at most.
VIEW_PARTS, VIEW_GROWTH, VIEW_MOST = 1, 4, 256


def view_indexed(spark: SparkSession, index_path: str, order: list[str], mbr: str | None = None, fmt: str = "json", extents: bool = False) -> DataFrame:
    """The first record of an index by box, partition and ``order``.

    Partitions whose box meets the query are read in their order, a growing number at a time, until one has a record, box after box.
    """
    rows = indexed_input(read_index(spark, index_path))
    names = [c for c in G.attribute_columns(rows) if c not in ("part_id", *order)]
    master = read_master(spark, index_path)
    for box in query_boxes(mbr, False) if mbr is not None else [None]:
        parts = (prune_partitions(master, [box]) if box else master).select("part_id")
        last, n = -1, VIEW_PARTS
        while ids := [r["part_id"] for r in parts.where(F.col("part_id") > last).orderBy("part_id").limit(n).collect()]:
            some = rows.where(F.col("part_id").isin(ids))
            record = view_feature(some, ["part_id", *order], box, fmt, extents, attributes=names).first()["record"]
            if record != NOTHING:
                return spark.createDataFrame([(record,)], "record string")
            last, n = ids[-1], min(VIEW_GROWTH * n, VIEW_MOST)
    return spark.createDataFrame([(NOTHING,)], "record string")

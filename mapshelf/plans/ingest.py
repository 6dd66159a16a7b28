"""Processing of one dataset: unpack, summarize, index, tiles, with its status kept after each stage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.operators import catalog as C
from mapshelf.operators.breaking import DEFAULT_THRESHOLD
from mapshelf.operators.indexing import build_indexes, path_exists, read_index, replace_folder
from mapshelf.operators.summary import attribute_types, summarize
from mapshelf.operators.tiles import LEVELS, tile_counts, write_pyramid
from mapshelf.sources.archives import expand_archives, list_archives
from mapshelf.sources.readers import read_dataset

# The extension point of a tile image and the default run options.
TILE_EXTENSION = ".png"


@dataclass
class Run:
    """Run options; dataset options of the catalog row win over ``options``."""
    base: str
    options: dict[str, str] = field(default_factory=dict)
    threshold: int = DEFAULT_THRESHOLD
    separate: bool | None = None
    overwrite: bool = True
    decompress: bool = True
    levels: int = LEVELS
    method: str = "rsgrove"
    vector_limit: int = C.VECTOR_LIMIT


def _row(table: C.CatalogTable, dataset_id: str):
    found = C.find(table.read(), dataset_id).collect()
    if not found:
        raise KeyError(f"No dataset '{dataset_id}'")
    return found[0]


def _save(table: C.CatalogTable, dataset_id: str, **values) -> None:
    spark = table.spark
    schema = [f"{k} {t}" for k, t in (d.split(" ", 1) for d in C.CATALOG_SCHEMA.split(", ")) if k in values]
    names = [s.split(" ", 1)[0] for s in schema]
    change = spark.createDataFrame([(dataset_id, *[values[n] for n in names])], ", ".join(["_id string", *schema]))
    table.update(change)


def load_features(spark: SparkSession, folder: str, options: dict[str, str]) -> DataFrame:
    return read_dataset(spark, f"{folder}/download", options)


def summarize_stage(features: DataFrame) -> dict:
    summary = summarize(features).first().asDict()
    first = features.limit(1).withColumn("_row", F.lit(0))
    types = [t for t in attribute_types(first, "_row").collect() if t.name != "_row"]
    summary["attributes"] = [(t.name, t.type) for t in types] or None
    return summary


def index_stage(features: DataFrame, folder: str, run: Run, row) -> None:
    separate = run.separate
    if separate is None:
        separate = bool(row["num_features"]) and (row["num_points"] or 0) // row["num_features"] >= run.threshold
    build_indexes(features, folder, separate, run.threshold, run.overwrite, method=run.method)


def tile_stage(spark: SparkSession, folder: str, relative: str, size: int | None, points: bool, run: Run):
    """Visualization entry of the catalog; datasets of ``run.vector_limit`` bytes or more get a pyramid of tile counts."""
    if (size or 0) < run.vector_limit:
        return ("Vector", f"/dynamic/download.cgi/{relative}/data_index.geojson")
    index = f"{folder}/viz_index" if path_exists(spark, f"{folder}/viz_index") else f"{folder}/data_index"
    staged = f"{folder}/temp_plot_{uuid.uuid4().hex}"   # beside its place, so the rename stays in one file system
    write_pyramid(tile_counts(read_index(spark, index), run.levels, points=points), staged)
    replace_folder(spark, staged, f"{folder}/plot", run.overwrite)
    return ("Tile", f"/dynamic/visualize.cgi/{relative}/plot.zip/tile-{{z}}-{{x}}-{{y}}{TILE_EXTENSION}")


def process_dataset(table: C.CatalogTable, dataset_id: str, run: Run) -> str:
    """Run the stages that are left for one dataset and return its status.

    A failure adds ``-error`` to the last saved status. The files of a new dataset are
    expected in its ``download`` folder.
    """
    spark = table.spark
    row = _row(table, dataset_id)
    status = row["status"]
    if status not in C.STAGES[:-1]:
        _save(table, dataset_id, status=f"{status}-error")
        return f"{status}-error"
    relative = row["name"] or row["_id"]
    folder = f"{run.base.rstrip('/')}/{relative}"
    options = {**run.options, **(row["options"] or {})}
    todo = [s for s in C.STAGES[C.STAGES.index(status) + 1:] if run.decompress or s != "decompressed"]
    try:
        for stage in todo:
            values: dict = {}
            if stage == "downloaded":
                if not path_exists(spark, f"{folder}/download"):
                    raise FileNotFoundError(f"{folder}/download")
            elif stage == "decompressed":
                if not list_archives(spark, f"{folder}/download").select("path").isEmpty():
                    expand_archives(spark, f"{folder}/download")
            elif stage == "summarized":
                values = summarize_stage(load_features(spark, folder, options))
            elif stage == "indexed":
                index_stage(load_features(spark, folder, options), folder, run, _row(table, dataset_id))
                values = {"index_path": f"{relative}/data_index"}
            elif stage == "ready":
                row = _row(table, dataset_id)
                points = row["geometry_type"] == "Point"
                values = {"visualization": tile_stage(spark, folder, relative, row["size"], points, run)}
            status = stage
            _save(table, dataset_id, status=stage, **values)
    except Exception:
        _save(table, dataset_id, status=f"{status}-error")
        raise
    return status


def process_pending(table: C.CatalogTable, run: Run, dataset_id: str | None = None, reset: str | None = None) -> list[str]:
    """Process one dataset, or all in ``created``, one after the other; failures do not stop the rest."""
    results = []
    for r in C.select_pending(table.read(), dataset_id, reset).select("_id", "status").collect():
        if reset is not None:
            _save(table, r["_id"], status=reset)
        try:
            results.append(process_dataset(table, r["_id"], run))
        except Exception as problem:  # the status in the catalog says where it stopped
            results.append(f"{r['_id']}: {problem}")
    return results


def reindex(table: C.CatalogTable, dataset_id: str, run: Run) -> str:
    """Build the indexes of one dataset again; its status becomes ``indexed``."""
    spark, row = table.spark, _row(table, dataset_id)
    relative = row["name"] or row["_id"]
    folder = f"{run.base.rstrip('/')}/{relative}"
    options = {**run.options, **(row["options"] or {})}
    index_stage(load_features(spark, folder, options), folder, run, row)
    _save(table, dataset_id, status="indexed", index_path=f"{relative}/data_index")
    return "indexed"

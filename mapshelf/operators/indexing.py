"""Index folders: ``data/part_id=N/`` Parquet files and a ``master`` manifest table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapshelf.functions import geometry as G
from mapshelf.functions.grid import interleave, world_column, world_row
from mapshelf.operators.breaking import DEFAULT_THRESHOLD, break_geometries, strip_attributes, viz_features
from mapshelf.operators.partitioning import spatial_partition
from mapshelf.operators.summary import feature_bytes, partition_stats
from mapshelf.session import scratch_path

ZKEY_BITS = 24


def _paths(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _paths(spark, path)
    return fs.exists(p)


def replace_folder(spark: SparkSession, source: str, target: str, overwrite: bool = True) -> None:
    """Put a finished folder in place of ``target``; without ``overwrite`` a taken target is
    an error.

    The old folder is moved aside and goes last, so a failure at any point leaves one of both
    in full; a rename that fails puts the old one back.
    """
    fs, dst = _paths(spark, target)
    src = spark._jvm.org.apache.hadoop.fs.Path(source)
    if fs.exists(dst):
        if not overwrite:
            raise FileExistsError(f"Directory '{target}' already exists and overwrite flag is not set")
    if dst.getParent() is not None:
        fs.mkdirs(dst.getParent())
    aside = dst.suffix(f".old-{uuid.uuid4().hex}") if fs.exists(dst) else None
    if aside is not None and not fs.rename(dst, aside):
        raise OSError(f"Could not move '{target}' aside")
    if not fs.rename(src, dst):
        if aside is not None:
            fs.rename(aside, dst)
        raise OSError(f"Could not rename '{source}' to '{target}'")
    if aside is not None:
        fs.delete(aside, True)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _paths(spark, path)
    fs.delete(p, True)


def _index_rows(partitioned: DataFrame) -> DataFrame:
    f = G.with_mbr(partitioned)
    f = f.selectExpr("*", f"coalesce({G.num_points('geom')}, 0) AS n_points")
    f = f.selectExpr("*", f"{feature_bytes(f)} AS n_bytes",
                     f"{world_column('(xmin + xmax) / 2', ZKEY_BITS)} AS _zx",
                     f"{world_row('(ymin + ymax) / 2', ZKEY_BITS)} AS _zy")
    return f.selectExpr("*", f"{interleave('_zx', '_zy', ZKEY_BITS)} AS zkey").drop("_zx", "_zy")


def add_to_index(partitioned: DataFrame, path: str, by: str) -> None:
    """Write more partitions to an index that is being made, and their part of the manifest.

    The manifest is taken from the rows, and the other folders are not listed, so the driver holds the names of
    these partitions only. No partition may have been written before; the rows are read twice.
    """
    f, folders = _index_rows(partitioned), [by, "part_id"]
    (f.hint("rebalance", *folders)
     .sortWithinPartitions(*folders, "zkey")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{path}/data"))
    partition_stats(f, by).write.mode("append").parquet(f"{path}/master")


def save_index(partitioned: DataFrame, path: str, by: str | None = None) -> None:
    """Write rows that have a ``part_id``, then their manifest. ``by`` names the column of several datasets' names.

    The rebalance hint shuffles by ``part_id`` and lets the adaptive plan cut a partition
    that is too large for one task into several and merge small ones. Rows are in Z-order
    inside each file, so the row group statistics of the box columns are tight.
    """
    f = _index_rows(partitioned)
    folders = ([by] if by else []) + ["part_id"]
    (f.hint("rebalance", *folders)
     .sortWithinPartitions(*folders, "zkey")
     .write.mode("errorifexists").partitionBy(*folders).parquet(f"{path}/data"))
    stats = partition_stats(read_index(partitioned.sparkSession, path), by)
    stats.write.mode("errorifexists").parquet(f"{path}/master")


def build_index(features: DataFrame, path: str, method: str = "rsgrove", overwrite: bool = True,
                **options) -> None:
    """Partition, write next to the target, then put in place."""
    spark = features.sparkSession
    if not overwrite and path_exists(spark, path):
        raise FileExistsError(f"Directory '{path}' already exists and overwrite flag is not set")
    parent, _, name = path.rstrip("/").rpartition("/")
    staged = f"{parent}/temp_{name}_{scratch_path(spark, 'x')[-32:]}"
    save_index(spatial_partition(features, method, **options), staged)
    replace_folder(spark, staged, path, overwrite)


def build_indexes(features: DataFrame, dataset_dir: str, separate: bool, threshold: int = DEFAULT_THRESHOLD,
                  overwrite: bool = True, **options) -> None:
    """The data index, and the index for drawing when it is kept apart."""
    build_index(features, f"{dataset_dir}/data_index", overwrite=overwrite, **options)
    if separate:
        build_index(viz_features(features, threshold), f"{dataset_dir}/viz_index", overwrite=overwrite, **options)


def break_and_index(features: DataFrame, path: str, method: str = "rsgrove",
                    threshold: int = DEFAULT_THRESHOLD, **options) -> None:
    """Break, drop the attributes, index. A missing geometry fails the job."""
    geom = F.coalesce(F.col("geom"), F.raise_error(F.lit("Missing geometry")).cast(G.GEOM))
    broken = break_geometries(features.select(geom.alias("geom")), threshold)
    build_index(strip_attributes(broken), path, method, **options)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def read_master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/master")


# Column names and types of the text manifest.
TEXT_MANIFEST = (
    "part_id int, file_name string, record_count long, nonempty_count long, num_points long, "
    "data_size long, sum_x double, sum_y double, boundary string, xmin double, ymin double, "
    "xmax double, ymax double")


def read_text_master(spark: SparkSession, path: str) -> DataFrame:
    """Import a tab-separated manifest. Spark skips files whose name starts with an
    underscore, so the file is copied to the scratch folder under a plain name first."""
    fs, src = _paths(spark, path)
    target = scratch_path(spark, "manifest") + ".tsv"
    dst_fs, dst = _paths(spark, target)
    dst_fs.mkdirs(dst.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(
        fs, src, dst_fs, dst, False, spark._jsc.hadoopConfiguration())
    return spark.read.schema(TEXT_MANIFEST).csv(target, sep="\t", header=True)


def indexed_input(df: DataFrame) -> DataFrame:
    """Index rows without the helper columns."""
    return df.drop("n_points", "n_bytes", "zkey")

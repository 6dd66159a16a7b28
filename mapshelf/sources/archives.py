"""Zip archives: entries as rows, or unpacked in place by the tasks that read them."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from mapshelf.session import materialize

CHUNK = 8 << 20
ENTRY_SCHEMA = "archive string, folder string, entry string, chunk long, content binary"


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[0]


def _on_file_system(path: str) -> bool:
    return path.startswith(("/", "file:"))


def _plain(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the top-level ``.zip`` files of a folder, whatever the case of the extension,
    and ``content`` where it is asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)


def _files_of(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [info for info in archive.infolist() if not info.filename.endswith("/")]


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all archives in chunks of bounded size; folders are skipped and archives
    inside archives stay as they are. ``chunk`` numbers the parts of an entry from 0.

    Archives on a file system are read where they are; others pass through the file reader,
    one archive at a time.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                source = io.BytesIO(row.content) if hasattr(row, "content") else _plain(row.path)
                with zipfile.ZipFile(source) as archive:
                    for info in _files_of(archive):
                        with archive.open(info) as f:
                            number, block = 0, f.read(CHUNK)
                            while number == 0 or block:
                                yield pd.DataFrame(
                                    [(row.path, _stem(row.path), info.filename, number, block)],
                                    columns=["archive", "folder", "entry", "chunk", "content"])
                                number, block = number + 1, f.read(CHUNK)

    columns = ["path"] if _on_file_system(path) else ["path", "content"]
    return _one_by_one(list_archives(spark, path).select(*columns)).mapInPandas(unpack, ENTRY_SCHEMA)


def _one_by_one(archives: DataFrame) -> DataFrame:
    """Spread archives over the tasks of the session."""
    return archives.repartition(archives.sparkSession.sparkContext.defaultParallelism, "path")


def expand_archives(spark: SparkSession, path: str) -> DataFrame:
    """Unpack every archive of a folder that all executors see under the same name, then
    remove the archives. Gives one row per written file: archive, file, bytes.

    Files appear under their final name only when complete, so a repeated task does no harm.
    """
    if not _on_file_system(path):
        raise ValueError(f"Not a folder that tasks can write to: '{path}'")
    root = _plain(path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                base = os.path.realpath(os.path.join(root, _stem(name)))
                with zipfile.ZipFile(_plain(name)) as archive:
                    for info in _files_of(archive):
                        target = os.path.realpath(os.path.join(base, info.filename))
                        if not target.startswith(base + os.sep):
                            raise ValueError(f"Entry '{info.filename}' of {name} points outside its folder")
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
                        with archive.open(info) as src, open(draft, "wb") as dst:
                            while block := src.read(CHUNK):
                                dst.write(block)
                        os.replace(draft, target)
                        yield pd.DataFrame([(name, target, info.file_size)], columns=["archive", "file", "bytes"])

    archives = list_archives(spark, path).select("path")
    names = [r.path for r in archives.collect()]
    written = materialize(_one_by_one(archives).mapInPandas(
        write, "archive string, file string, bytes long"), "expanded")
    for name in names:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(name)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, False)
    return written

"""Session settings and the shared scratch folder.

Intermediate tables are written below the folder the session names in
``spark.checkpoint.dir``; every executor can read them again, so a lost executor costs a
re-read and not a re-run. A private folder is used only when the setting is absent, which
is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",   # a bad number fails the job
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_local_scratch: str | None = None
_shipped: set[str] = set()


def ship_package(spark: SparkSession, *more: str) -> None:
    """Send this package, and the folders of other modules, to the executors, once in a session.

    Functions that run in Python tasks import it there. Where it is installed on all machines this is not needed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="mapshelf-", dir=os.environ.get("TMPDIR", "/tmp"))), "mapshelf_modules.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder in (os.path.dirname(os.path.abspath(__file__)), *more):
            for at, _, names in os.walk(folder):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(folder)))
    sc.addPyFile(target)


def build_session(app: str = "mapshelf", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session, or a private one where none is set."""
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="mapshelf-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/mapshelf/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    The written table cuts the lineage and gives the optimizer a true size, so whether a
    later join broadcasts it is decided from its bytes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)

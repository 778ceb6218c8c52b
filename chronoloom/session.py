"""The session that the engine's own entry points use."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale; cluster size, memory and partition counts are the deployer's.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,parquet,text",
}


def session(app: str = "chronoloom", zone: str = "UTC", **settings: str) -> SparkSession:
    """A session in the report's time zone; ``settings`` use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", zone)
    return spark


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="chronoloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@cache
def _shared_folder(base: str, application: str) -> str:
    """The application's own folder in a shared one; the file system deletes it when the driver ends."""
    path = f"{base.rstrip('/')}/chronoloom-{application}"
    spark = SparkSession.active()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return path


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Everything that is ``kept`` inside is freed at the end, so results must be complete by then."""
    held: list[DataFrame] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for df in held:
            released(df)


def kept(df: DataFrame) -> DataFrame:
    """Rows that many later steps read, computed once; what is planned over them starts anew.

    They are Parquet in a folder of the application below the one that ``spark.checkpoint.dir``
    names, and so outlive lost executors; it goes with the application, or before by ``scratch``
    and ``released``. Without that setting one machine's tasks write to a folder of their own,
    and a cluster keeps rows in its memory and disks, where lost blocks are computed again.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        folder = _shared_folder(base, spark.sparkContext.applicationId)
    elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = f"file://{_own_folder()}"
    else:
        folder = None
    if folder:
        path = f"{folder}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows = spark.read.schema(df.schema).parquet(path)
    else:
        rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _scopes:
        _scopes[-1].append(rows)
    return rows


def released(df: DataFrame) -> None:
    """Free what ``kept`` holds; the rows are gone after."""
    spark = df.sparkSession
    df.unpersist()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/kept-[0-9a-f]{32}$", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch that carries whole texts to Python, where the session leaves Spark's default of 10,000.
BATCH_ROWS = 2000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(docs: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """The rows; their session sends at most so many at once to Python unless it says otherwise.

    Spark also ends a batch at 64 MB, so neither many nor long texts fill a worker's memory.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH_SETTING) == "10000":
        conf.set(_BATCH_SETTING, str(rows))
    return docs


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where one machine runs all tasks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="chronoloom-")


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/chronoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/chronoloom-[0-9a-f]{32}$", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def id_text(name: str) -> Column:
    """An id as text; null counts as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, which deals rows into folds."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))

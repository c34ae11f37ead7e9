"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting: shuffle files go at the end of a SQL execution.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a temporary folder; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/apisight-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, and lost executors cost no recomputation.

    Shuffle files of the write are removed when it is done, for nothing reads them again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    had = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, had)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(table: DataFrame) -> None:
    """Deletes what materialise() wrote for this very frame; nothing may read it afterwards."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores put before them until none is taken (in any case of letters)."""
    had, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in had:
            name = "_" + name
        had.add(name.lower())
        out.append(name)
    return out

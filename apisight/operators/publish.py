"""Small files that are there whole or not at all."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, name: str):
    """The path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, name: str) -> None:
    path, fs = hadoop_path(spark, name)
    fs.delete(path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = hadoop_path(spark, folder)
    return sorted(str(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []


def read_json(spark: SparkSession, name: str) -> dict | None:
    """What a published file says; None if it is missing or torn."""
    path, fs = hadoop_path(spark, name)
    if not fs.exists(path):
        return None
    try:
        stream = fs.open(path)
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        found = json.loads(text)
    except (ValueError, Py4JJavaError):
        return None
    return found if isinstance(found, dict) else None


def publish(spark: SparkSession, name: str, row: dict, replace: bool = False) -> bool:
    """Writes the row beside, under a name of its own, and renames it. Without replace, False if the name is taken; with it, what was there goes in
    the same step, so a reader sees the old row or the new one."""
    path, fs = hadoop_path(spark, name)
    text, beside = json.dumps(row) + "\n", f"{name.rpartition('/')[0]}/.unpublished-{uuid.uuid4().hex}"
    temporary, _ = hadoop_path(spark, beside)
    if fs.getScheme() == "file":  # the driver's own; Hadoop's rename of a local file is no single step
        return _publish_local(path.toUri().getPath(), temporary.toUri().getPath(), text, replace)
    stream = fs.create(temporary, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if not replace:
            return bool(fs.rename(temporary, path))  # overwrites nothing in HDFS and its like
        jvm = spark.sparkContext._jvm
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, path, options)
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    finally:
        fs.delete(temporary, False)


def _publish_local(path: str, temporary: str, text: str, replace: bool) -> bool:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(temporary, "w", encoding="utf-8") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    try:
        if replace:
            os.replace(temporary, path)
        else:
            os.link(temporary, path)
        return True
    except FileExistsError:
        return False
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)

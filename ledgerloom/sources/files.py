"""Small files of any file system Spark reaches: read, publish under a free name, swap, remove."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _written_beside(spark: SparkSession, path: str, text: str):
    """A file of its own attempt in the folder of ``path``, complete, and the parts of a rename onto ``path``."""
    folder, _, name = path.rpartition("/")
    fs, attempt = _path(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    out = fs.create(attempt, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(attempt.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    return fs, attempt, target, context, getattr(jvm.org.apache.hadoop.fs, "Options$Rename")


def _renamed(spark: SparkSession, context, attempt, target, kinds: list) -> None:
    rename = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, len(kinds))
    for i, kind in enumerate(kinds):
        options[i] = kind
    context.rename(attempt, target, options)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Put ``text`` at ``path`` as a whole, unless a file is there already: then False, and that file stays."""
    fs, attempt, target, context, _ = _written_beside(spark, path, text)
    try:
        _renamed(spark, context, attempt, target, [])
        return True
    except Exception:
        if not fs.exists(target):
            raise
        return False
    finally:
        fs.delete(attempt, False)


def swap(spark: SparkSession, path: str, text: str) -> None:
    """Put ``text`` at ``path`` in one step: readers see the old file or the new one."""
    fs, attempt, target, context, rename = _written_beside(spark, path, text)
    try:
        _renamed(spark, context, attempt, target, [rename.OVERWRITE])
    finally:
        fs.delete(attempt, False)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)

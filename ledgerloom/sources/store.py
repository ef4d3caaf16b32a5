"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a temporary folder stands in on a local master; elsewhere executors couldn't read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the end of the process removes it."""
    path = f"{shared_root(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"
    _held[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts its lineage and survives lost executors. ``discard`` or the end of the process removes it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``written`` wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_ledgerloom_path", None)
        if path:
            _delete(path, df.sparkSession)


def _delete(path: str, spark: SparkSession) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _held.pop(path, None)


@atexit.register
def _clean_up() -> None:
    for path, spark in list(_held.items()):
        try:
            if spark.sparkContext._jsc is None:
                return
            _delete(path, spark)
        except Exception:  # the JVM may be gone already
            return

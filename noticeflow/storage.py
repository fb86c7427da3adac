"""Tables written once to the folder that all executors share, to cut lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a session
without that setting (tests in one process) gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a session that names none must be a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="noticeflow-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_cleaned: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/noticeflow/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder; it belongs to the application and goes with it, or by ``clean``."""
    own = _own_dir(spark)
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_quietly, spark)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        clean(spark)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Removes all tables that this application has written and not dropped.

    Results that were not consumed yet cannot be read any more.
    """
    _delete(spark, _own_dir(spark))


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, computed once and read from the shared folder from now on."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of ``written`` that no later step reads."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(spark, folder)

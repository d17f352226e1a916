"""Session helpers: reading tables, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_WRITTEN: set[str] = set()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder; columns are pruned by whoever uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stamp(spark: SparkSession, path: str) -> tuple | None:
    """What tells one state of a file or folder from another: where its files are, how long and when written; None if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)) if fs.exists(at) else None


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process, so that a folder of this machine is shared by all."""
    return bool(re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where none is named, a temporary one is made if driver and tasks are one process; on a cluster that is an error,
    since executors on several machines would each write to a disk of their own.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not named:
        if not one_machine(spark):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="varilake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def written_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are. They are deleted by release(), or when the program ends."""
    folder = f"{shared_folder(spark)}/varilake/{spark.sparkContext.applicationId}"
    if folder not in _WRITTEN:
        _WRITTEN.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    """Through Hadoop's file system, so wherever the shared folder is; works after the session has ended too."""
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())).delete(path, True)
    except Exception as e:  # the JVM is gone: nothing more can be done from here
        print(f"{folder} was not deleted: {type(e).__name__}", file=sys.stderr)
    _WRITTEN.discard(folder)


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application, for when all results that rest on them have been written."""
    _delete(spark, written_folder(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{written_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

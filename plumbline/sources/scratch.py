"""Scratch tables in the folder that the whole cluster shares.

Iterative jobs cut their lineage here: a scratch table is plain Parquet in the folder named by
``spark.checkpoint.dir``, so that it outlives any executor. Where that setting is absent a temporary folder of
this machine is used if the master is local (tests, a laptop); on a cluster that is an error, since executors
would each write to their own disks.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """URI of this application's folder for scratch tables."""
    context = spark.sparkContext
    app = context.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local.get(app) or _local.setdefault(app, tempfile.mkdtemp(prefix="spark-scratch-"))
    return f"{base.rstrip('/')}/scratch-{app}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder under the scratch root."""
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a scratch table and return it as read back: one evaluation, short lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete scratch tables (as ``materialize`` returned them) that nothing will read again; others are left."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            delete_folder(df.sparkSession, path)

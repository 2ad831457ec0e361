"""Tables written to the folder that the driver and all executors share.

A staged table cuts lineage, outlives a lost executor and is read again with
fresh statistics, so that later joins are planned by its true size.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def stage(df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
    """Write df once to the shared folder, with the session's codec or another, and return a DataFrame over the written files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)

"""Written tables that cut a plan's lineage, in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that the context has. Only a local session gets a temporary one; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _own(spark: SparkSession) -> str:
    """A folder of this session's own, which goes when its JVM ends."""
    if spark not in _FOLDERS:
        uri = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[spark] = uri
    return _FOLDERS[spark]


def kept(df: DataFrame) -> DataFrame:
    """df as a written table: later plans read it, and a lost executor costs a reread, not a rerun."""
    uri = f"{_own(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)

"""What the operators share: tables, scratch tables on the shared folder, hashing and local forests."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder

#: Words everywhere: runs of other characters than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local session that names none gets a temporary one, on a cluster that is an error."""
    return shared_folder(spark)


class Scratch:
    """Written tables under the shared folder. They cut the lineage, so a lost executor costs a reread, not a rerun.

    The folder goes when the session's JVM ends; ``drop`` frees a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.uri = f"{checkpoint_dir(spark)}/quire-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.uri)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, uri: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(uri)

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a written table."""
        self._n += 1
        uri = f"{self.uri}/t{self._n}"
        df.write.parquet(uri)
        kept = self.spark.read.schema(df.schema).parquet(uri)
        kept._quire_uri = uri
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            self.drop_uri(df._quire_uri)

    def drop_uri(self, uri: str) -> None:
        path = self._path(uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Counted rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free_name(name: str, taken) -> str:
    """name, with as many underscores behind it as no column of taken has, whatever the case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def utf8(col):
    """A string column as bytes, null as empty."""
    return F.coalesce(F.encode(col, "UTF-8"), F.lit(b""))


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each node's smallest known node) after joining the pairs a, b; in place."""
    while len(a):
        x, y = labels[a], labels[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
    return labels

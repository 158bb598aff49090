"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of 64-bit keys is broadcast (about 40 MB as a hash relation).
BROADCAST_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of this application where it is unset and all runs on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
    return root.rstrip("/")


#: Bytes and rows of a batch of texts that goes to a Python worker; Spark's own defaults hold tens of MB.
BATCH_BYTES, BATCH_ROWS = "8m", 2_000


def bound_batches(spark: SparkSession) -> None:
    """Bound what a worker holds at a time; a session whose batches are smaller keeps them."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, BATCH_BYTES)


#: Spark's setting that deletes the shuffle files of a query when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written under one folder of the shared root and read again, which cuts their lineage.

    A lost executor takes nothing with it: what was written is read from the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/rasterloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, str] = {}

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n}-{name}"

    def save(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """df as a table; release deletes the shuffle files of its writing at once, which nothing else may then read."""
        to = self.folder(name)
        before = self.spark.conf.get(RELEASE)
        if release:
            self.spark.conf.set(RELEASE, "true")
        try:
            df.write.parquet(to)
        finally:
            self.spark.conf.set(RELEASE, before)
        out = self.spark.read.schema(df.schema).parquet(to)
        self._at[id(out)] = to
        out._rasterloom_path = to
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            self._delete(t._rasterloom_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those asked for that df does not have, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, with any signs in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of value as bytes for pickle.loads(); its class goes along, so executors need no copy of the package."""
    bound_batches(spark)
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame


def shared_root(df: DataFrame) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset and all runs on this machine, a folder of this application."""
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/{context.applicationId}"
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
    return root.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: what is used several times is computed once, plans stay short, and a lost executor costs no earlier step."""
    path = f"{shared_root(df)}/rasterloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: str, rows: int) -> DataFrame:
    """df dealt by a key to as many tasks as it has so many rows; for rows of which far more is made than their size in files and shuffles tells Spark."""
    return df.repartition(max(1, -(-df.count() // rows)), by)

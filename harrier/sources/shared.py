"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The setting spark.checkpoint.dir. Where it is unset, a session that runs in one process gets a temporary folder;
    any other one raises an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet in the shared folder."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def few(frame: DataFrame, most: int = 200_000) -> DataFrame:
    """The same rows, to be broadcast if there are few: a join with them then leaves a large table where it lies."""
    return F.broadcast(frame) if frame.count() <= most else frame


def plain_unions(spark: SparkSession) -> None:
    """Has unions of this session keep no partitioning of their branches.

    Spark 4.1 takes a union of tables that are partitioned alike for one that is partitioned so too. Where adaptive
    execution then changes a branch, rows of one key stay apart, and places within groups are wrong, or the plan fails
    with "Can't zip RDDs with unequal numbers of partitions". Older versions lack the setting and don't mind it.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")

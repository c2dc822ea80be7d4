"""Durable cuts in a plan's lineage.

Iterative operators must not recompute every earlier round after an executor is lost,
so they cut with a reliable checkpoint in a folder that all executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, computed once a row however often it is read later.

    The optimizer writes a projected expression out wherever it is read, so long chains are computed many times over; what a
    generator gives it leaves alone.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What is computed inside sends at most ``most`` rows a batch to Python.

    A batch of long texts is held several times over, by the JVM and by the worker of every Python step of every task.
    """
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(most if int(before) <= 0 else min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only on a local master, where one machine is the cluster.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-checkpoint-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """``df`` written beside the checkpoints as a table and read back, for loops.

    A checkpoint hands the constraints of its plan on to the next one; over the rounds of a loop they multiply until
    planning takes longer than the work.  A stored table has none, and its true size decides on broadcasts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "rounds")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

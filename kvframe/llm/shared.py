"""Shared-folder tables, size-checked joins and input sizes: what every operator here needs of the session."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of its stored form, that is broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20
#: Spark's stand-in for the size of what it knows nothing of is larger than this.
UNKNOWN_BYTES = 1 << 60


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where that is unset and all run in one process (tests), a new one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kvframe-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of some megabytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


class Scratch:
    """Tables written to the shared folder; they cut lineage and outlive lost executors. Results read them, so they go when Python ends."""

    _made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made.append(self)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bytes(self, name: str) -> int:
        fs, where = self._fs(f"{self.root}/{name}")
        return fs.getContentSummary(where).getLength()

    def drop(self, name: str) -> None:
        fs, where = self._fs(f"{self.root}/{name}")
        fs.delete(where, True)


@atexit.register
def clear() -> None:
    """Removes all scratch folders of this process."""
    while Scratch._made:
        one = Scratch._made.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            fs, where = one._fs(one.root)
            fs.delete(where, True)


def small_enough(df: DataFrame, stored: int) -> DataFrame:
    """`df` marked for broadcast if its stored form is under BROADCAST_BYTES, else `df` as it is."""
    return F.broadcast(df) if stored <= BROADCAST_BYTES else df


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame is made from, at least 1: the sizes of its plan's leaves, each as often as it is read.

    (Catalyst's estimate of the frame itself is no measure: that of a join is the product of its sides.) Leaves
    without files count by their rows, those of unknown size not at all.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(1, sum(n for n in sizes if n < UNKNOWN_BYTES))

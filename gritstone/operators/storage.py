"""Tables in the folder that all executors share: they cut lineage, survive executors, and give Catalyst columns to prune and true sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table up to which it may be broadcast whatever the session's own threshold; far below an executor's memory.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the checkpoint folder that the context was given.

    Where neither is set, one is made only if driver and executors are one process (a local master, as in tests); on a
    cluster a folder of one machine would lose tables, so an error says what to set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gritstone-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table that ``stored`` returned, marked for broadcast only while its measured size (columnar, so times 4) is under the limit; else left to a shuffle join."""
    return F.broadcast(df) if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * 4 <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by the hash of keys over as many tasks as the session has for shuffles, one a core at least: for small rows that cost much, which a
    partitioning by size would leave to a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)

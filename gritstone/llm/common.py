"""What the corpus operators share: reading, shared-folder tables, size-checked joins, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table up to which it may be broadcast whatever the session's own threshold; far below an executor's memory.
BROADCAST_BYTES = 8 << 20
#: Rows of text a kernel sees at a time. Spark itself ends an Arrow batch at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set).
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the checkpoint folder that the context was given.

    Where neither is set, one is made only if driver and executors are one process (a local master, as in tests); on a
    cluster a folder of one machine would lose tables, so an error says what to set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gritstone-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the lineage, survives executors, and gives Catalyst true sizes.

    The files stay as long as results that read them may: ``discard`` removes all of a session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove every table that this application stored: call it once the results that read them are written."""
    _forget(spark, f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}")


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that ``stored`` returned."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored key table, marked for broadcast only while its measured size (columnar, so times 4) is under the limit; else left to a shuffle join."""
    return F.broadcast(df) if stored_bytes(df) * 4 <= limit else df


def keyed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Only the named columns, of rows that have a doc_id: other columns, whatever their names, never meet an operator's own."""
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", *columns)


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, as views."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def arrow_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = TEXT_ROWS) -> DataFrame:
    """``mapInArrow`` whose function sees at most ``rows`` rows at a time; no session setting is read or changed."""
    return df.mapInArrow(lambda batches: f(pieces_of(batches, rows)), schema)


def hash_part(parts: Column, *columns: str | Column) -> Column:
    """Which of ``parts`` equal ranges of 31 bits the hash of the columns falls into: in the order of (hash_order, ...), whatever the number of parts."""
    return F.shiftright(hash_order(*columns) * parts, 31).cast("int")


def hash_order(*columns: str | Column) -> Column:
    """The hash that rows are ordered by where an order must not follow their ids: 31 bits as bigint, so its product with a number of parts doesn't overflow."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 31) - 1))


def with_ids(docs: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose doc_id is (or isn't) in the one column of ``ids``, one row of each doc_id, with all columns as they are.

    Of rows that repeat a doc_id the first in the order of their JSON forms stays. Rows without a doc_id go. Rows travel
    as one struct, so no column of theirs, whatever its name, meets a name of ours."""
    whole = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), F.struct("*").alias("row"))
    rows = whole.join(small_side(stored(ids.toDF("id"), "ids")), F.col("key") == F.col("id"), "left_semi" if keep else "left_anti")
    again = stored(keyed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("id")), "repeated")
    if again.isEmpty():
        return rows.select("row.*")
    again = small_side(again)
    first = rows.join(again, F.col("key") == F.col("id"), "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(again, F.col("key") == F.col("id"), "left_anti").unionByName(first).select("row.*")

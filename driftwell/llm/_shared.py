"""Session settings that every operator of this subpackage shares."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one bucket of documents holds on average. A bucket is what one Python call sees.
BUCKET_BYTES = 6 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a folder beside the warehouse in local mode
    (tests, one machine); on a cluster an error, since a folder of one machine would lose data."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and not current.isEmpty():
        return current.get()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: its lineage ends, lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As cut, by a compressed table in the shared folder: for narrow rows a fraction of the bytes."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run inside hands Python functions so many rows at once: an executor holds several copies of each batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer files than there are cores, dealt over the cores; any other as it is. Without it
    one task would read all of a file with one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < 256 << 20 and len(df.inputFiles()) < cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of text in docs: one number, from a scan of one column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()[0])


def grown(size: int, total: int, most: int) -> int:
    """size up to 32 GB of text, from there with the root of the total, so that the blocks that buckets send to ranges
    get fewer a byte of text; never above most, which one task holds in memory."""
    return min(most, max(size, int(size * math.sqrt(total / (32 << 30)))))


def n_tasks(spark: SparkSession, total: int) -> int:
    """Tasks that a shuffle of about total bytes is dealt over: 64 MB each, or the session's number if that is more."""
    return max(partitions(spark), math.ceil(total / (64 << 20)))


def join_hot(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """rows joined with few (one row for each key), where single keys may hold a large part of rows.

    Keys of over a thousandth of all rows are at most a thousand, a proven bound for a broadcast; rows of these
    keys are spread over salts, and their rows in few stand once for each salt.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_total"))
    hot = F.broadcast(counts.crossJoin(F.broadcast(total)).where(F.col("_n") * 1000 > F.col("_total")).select(key, F.lit(True).alias("_hot")))
    others = [f"`{c}`" for c in rows.columns if c != key]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")).join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.col("_salt")).otherwise(0)).drop("_hot")
    every = few.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(every, [key, "_salt"], how).drop("_salt")


def in_buckets(docs: DataFrame, total: int, *cols: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """cols of docs dealt over buckets of about bucket_bytes of text, in a partitioning that groups by bucket keep.

    The bucket comes from a hash of the document id and the whole text, so rows
    with a null or repeated id spread as well, and a repeated run gives the same buckets.
    """
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    n = n_tasks(docs.sparkSession, total)
    bucket = F.pmod(F.xxhash64(*cols), F.lit(n_buckets)).cast("int").alias("bucket")
    return docs.select(bucket, *cols).repartition(n, "bucket")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct named row, so that names of helper columns cannot clash with its own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")

"""Event-time windows on streams. The histogram is the only streaming aggregate; totals and intervals follow per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.histogram import histogram, totals, with_wilson
from ..operators.records import abnormal_device, prepared
from ..sources.sensors import from_events


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Sensor records from a directory of event files, or from one file, as they come."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isDirectory():
        source, path = source.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return from_events(source.parquet(path))


def window_histogram(stream: DataFrame, cfg: Config, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, region, bucket, f) for tumbling or, with slide, sliding windows."""
    rows = prepared(stream.withWatermark("ts", late), cfg)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return histogram(rows.withColumn("w", window), "w").select(F.col("w.start").alias("start"), "region", "bucket", "f")


def session_counts(stream: DataFrame, cfg: Config, gap: str, late: str = "10 minutes") -> DataFrame:
    """(start, end, sensor_id, n): sessions of a device's abnormal readings."""
    rows = prepared(stream.withWatermark("ts", late), cfg).where(abnormal_device(cfg))
    per = rows.groupBy(F.session_window("ts", gap).alias("w"), "sensor_id").agg(F.count("*").alias("n"))
    return per.select("w.start", "w.end", "sensor_id", "n")


def device_sketches(stream: DataFrame, cfg: Config, width: str, late: str = "10 minutes") -> DataFrame:
    """(start, estimate): distinct abnormal devices of each window by a HyperLogLog, which streams can keep."""
    rows = prepared(stream.withWatermark("ts", late), cfg).where(abnormal_device(cfg))
    per = rows.groupBy(F.window("ts", width).alias("w")).agg(F.hll_sketch_agg("sensor_id").alias("sketch"))
    return per.select(F.col("w.start").alias("start"), F.hll_sketch_estimate("sketch").alias("estimate"))


def finish(hist: DataFrame, cfg: Config) -> DataFrame:
    return with_wilson(totals(hist, cfg, "start"), cfg.alpha)


def run(stream: DataFrame, cfg: Config, width: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Statistics of all windows after each batch, handed to write(stats, batch_id), which must be idempotent by batch."""
    hist = window_histogram(stream, cfg, width)
    each = lambda df, batch: write(finish(df, cfg), batch)
    return hist.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()

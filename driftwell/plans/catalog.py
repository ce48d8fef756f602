"""All queries by name over the driver's tables, with the SQL that must return the same rows.

The events table stands in for sensor records (sources.sensors.from_events).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.intervals import wilson
from ..operators import ams, bloom, countmin, distinct, lsh, sampling
from ..operators import alerts as alerting
from ..operators import histogram as hist_ops
from ..operators import records as rec
from ..sources import sensors
from . import windows
from .oracles import ORACLE_SQL

CFG = Config()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _records(spark: SparkSession, d: str) -> DataFrame:
    return sensors.from_events(spark.read.parquet(f"{d}/events.parquet"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return rec.prepared(_records(spark, d), CFG)


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return hist_ops.histogram(_rows(spark, d))


def _devices(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where(rec.abnormal_device(CFG))


def _suspects(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where(rec.suspect(CFG))


def _listed(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query
def impute(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("seq", "region", "sensor_id", "reading", "reading_hat", "confidence")


@query
def bucketize(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("seq", "bucket")


@query
def bucketize_tenth(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of another width, over the line items' prices."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("x"))
    return items.select("l_orderkey", "l_linenumber", rec.bucket_of(F.col("x"), 0.5).alias("bucket"))


@query
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("seq", "risk", F.round("score", 6).alias("score"))


@query
def features_a(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("seq", F.array_join(F.transform(rec.features_a(), lambda x: F.format_string("%.4f", x)), ",").alias("features"))


@query
def features_b(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("seq", F.array_join(F.transform(rec.features_b(), lambda x: F.format_string("%.4f", x)), ",").alias("features"))


@query
def anomaly_predicates(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("seq", rec.abnormal_bucket(CFG).alias("by_bucket"), rec.abnormal_device(CFG).alias("by_device"), rec.abnormal_sample(CFG, None).alias("by_sample"), rec.abnormal_sample(CFG, 0.5).alias("by_sample_confident"))


@query
def suspects(spark: SparkSession, d: str) -> DataFrame:
    return _suspects(spark, d).select("seq", "sensor_id", "reading_hat", "confidence")


@query
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return _hist(spark, d)


@query
def histogram_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """The same histogram over the largest table: return flags as regions, scaled prices as readings."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    region = F.when(F.col("l_returnflag") == "A", "R2").when(F.col("l_returnflag") == "N", "R3").otherwise("R4")
    rows = items.select(region.alias("region"), (F.col("l_extendedprice") / 500).alias("reading_hat"))
    return hist_ops.histogram(rec.bucketize(rows, CFG))


@query
def region_totals(spark: SparkSession, d: str) -> DataFrame:
    return hist_ops.totals(_hist(spark, d), CFG)


@query
def zero_regions(spark: SparkSession, d: str) -> DataFrame:
    cfg = replace(CFG, regions=("R2", "R3", "R4", "R9"))
    return hist_ops.zero_rows(hist_ops.totals(_hist(spark, d), cfg), cfg, "cms_total", "cms_abnormal")


@query
def heavy_buckets(spark: SparkSession, d: str) -> DataFrame:
    return hist_ops.heavy(_hist(spark, d), CFG).select("region", _listed("heavy_buckets"), "heavy_bucket_ratio")


def _wilson(alpha: float) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return hist_ops.with_wilson(hist_ops.totals(_hist(spark, d), CFG), alpha).select("region", *[F.round(c, 10).alias(c) for c in ("p_hat", "ci_low", "ci_high")])

    return run


QUERIES["wilson_05"], QUERIES["wilson_10"] = _wilson(0.05), _wilson(0.10)


@query
def wilson_goldens(spark: SparkSession, d: str) -> DataFrame:
    """Published counts and an empty one."""
    rows = spark.createDataFrame([("R2", 66, 300), ("R3", 279, 400), ("R4", 13, 250), ("none", 0, 0)], "region string, k long, n long")
    p, low, high = wilson(F.col("k"), F.col("n"), 0.05)
    return rows.select("region", p.alias("p_hat"), low.alias("ci_low"), high.alias("ci_high"))


@query
def distinct_global(spark: SparkSession, d: str) -> DataFrame:
    return distinct.distinct_all(_devices(spark, d))


@query
def distinct_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return distinct.distinct_by_region(_devices(spark, d)).select(F.coalesce("region", F.lit("all")).alias("region"), "n")


@query
def hll_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = _devices(spark, d)
    est = distinct.merged_estimate(distinct.sketch(rows, "region"))
    exact = distinct.distinct_all(rows)
    return exact.crossJoin(F.broadcast(est)).select("hll_estimate", (F.abs(F.col("estimate") - F.col("hll_estimate")) <= 0.1 * F.col("hll_estimate")).alias("within"))


@query
def cms_standard(spark: SparkSession, d: str) -> DataFrame:
    hist = _hist(spark, d)
    return hist.join(countmin.query(hist, countmin.cells(hist, CFG), CFG), ["region", "bucket"])


@query
def cms_conservative_flag(spark: SparkSession, d: str) -> DataFrame:
    hist = _hist(spark, d)
    both = countmin.conservative(hist, CFG).join(countmin.query(hist, countmin.cells(hist, CFG), CFG).withColumnRenamed("estimate", "standard"), ["region", "bucket"])
    return both.select("region", "bucket", "f", ((F.col("f") <= F.col("estimate")) & (F.col("estimate") <= F.col("standard"))).alias("within"))


@query
def cms_builtin(spark: SparkSession, d: str) -> DataFrame:
    return countmin.builtin(_rows(spark, d), CFG).select((F.length("sketch") > 0).alias("made"))


@query
def ams_z(spark: SparkSession, d: str) -> DataFrame:
    return ams.accumulators(_hist(spark, d), CFG)


@query
def ams_mom(spark: SparkSession, d: str) -> DataFrame:
    return ams.median_of_means(ams.accumulators(_hist(spark, d), CFG), CFG)


@query
def ams_mean(spark: SparkSession, d: str) -> DataFrame:
    cfg = replace(CFG, ams_sketches=5)
    return ams.mean(ams.accumulators(_hist(spark, d), cfg))


@query
def ams_blake(spark: SparkSession, d: str) -> DataFrame:
    """Estimates from BLAKE2s signs; no SQL has this hash."""
    return ams.median_of_means(ams.accumulators(_hist(spark, d), CFG, blake=True), CFG)


@query
def f2_exact(spark: SparkSession, d: str) -> DataFrame:
    return hist_ops.exact_f2(_hist(spark, d))


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return lsh.signatures(_rows(spark, d).withColumn("features", rec.features_b()).select("seq", "sensor_id", "features"), CFG, 4)


@query
def lsh_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("seq", "table_idx", "signature")


@query
def lsh_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of 64-dimensional vectors."""
    return lsh.signatures(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("features")), CFG, 64).select("vec_id", "table_idx", "signature")


@query
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    signed = _signed(spark, d)
    return lsh.candidates(signed, signed.where(F.col("seq") % 50 == 0), 100)


@query
def lsh_bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    big = lsh.bucket_stats(_signed(spark, d), 4, 3, 10)
    return big.select("table_idx", "signature", "size", F.round(F.get("means", F.lit(0)), 6).alias("mean_reading"), F.round(F.get("means", F.lit(1)), 6).alias("mean_confidence"), F.array_join("example_ids", ",").alias("example_ids"))


@query
def reservoir_global(spark: SparkSession, d: str) -> DataFrame:
    return sampling.reservoir(_rows(spark, d), CFG.reservoir_size).select("seq", F.round("key", 9).alias("key"))


@query
def reservoir_by_region(spark: SparkSession, d: str) -> DataFrame:
    return sampling.reservoir_by(_rows(spark, d), "region", 50).select("region", "seq", "place")


@query
def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    return sampling.weighted_choice(sampling.reservoir_by(_rows(spark, d), "region", 50), 20, CFG.bootstrap_seed)


@query
def bootstrap_expectation(spark: SparkSession, d: str) -> DataFrame:
    p = sampling.expectation(sampling.reservoir(_rows(spark, d), CFG.reservoir_size), CFG)
    return p.select("region", "n", F.round("p", 9).alias("p"))


@query
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    b = sampling.bootstrap(sampling.reservoir(_rows(spark, d), CFG.reservoir_size), CFG)
    return b.select("region", "n", *[F.round(c, 9).alias(c) for c in ("p_hat", "ci_low", "ci_high")])


@query
def sbf_positions(spark: SparkSession, d: str) -> DataFrame:
    return bloom.positions(_suspects(spark, d).select("sensor_id").distinct(), CFG)


@query
def sbf_semi(spark: SparkSession, d: str) -> DataFrame:
    """Records of devices that are suspect in some record."""
    return _rows(spark, d).join(_suspects(spark, d).select("sensor_id").distinct(), "sensor_id", "left_semi").select("seq", "sensor_id")


@query
def sbf_anti(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).join(_suspects(spark, d).select("sensor_id").distinct(), "sensor_id", "left_anti").select("seq", "sensor_id")


@query
def sbf_flag(spark: SparkSession, d: str) -> DataFrame:
    """Every suspect is found in a filter without decay."""
    own = _suspects(spark, d).select("sensor_id").distinct()
    found = bloom.maybe_members(own, own, CFG).withColumn("found", F.lit(True))
    return own.join(found, "sensor_id", "left").select("sensor_id", F.coalesce("found", F.lit(False)).alias("found"))


@query
def sbf_saturation(spark: SparkSession, d: str) -> DataFrame:
    return bloom.saturation(_suspects(spark, d), CFG)


_ROUNDED = ("p_hat", "ci_low", "ci_high", "heavy_bucket_ratio")


def _stats(stats: DataFrame, *more: str) -> DataFrame:
    return stats.select("region", *[F.round(c, 10).alias(c) for c in _ROUNDED], _listed("heavy_buckets"), "cms_total", "cms_abnormal", "hll_estimate", *more)


@query
def window_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(windows.window_stats(_records(spark, d), CFG), "ams_f2")


@query
def window_stats_lsh(spark: SparkSession, d: str) -> DataFrame:
    cfg = replace(CFG, ams_sketches=5)
    big = F.array_join(F.transform("lsh_big_buckets", lambda b: F.concat_ws(":", b["table_idx"], b["signature"], b["size"], F.array_join(b["example_ids"], ","))), ";")
    return _stats(windows.window_stats_lsh(_records(spark, d), cfg), "ams_f2", big.alias("lsh_big_buckets"))


@query
def evidence_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = windows.stage_stats(_records(spark, d), CFG)
    return s.select("region", "sample_size", *[F.round(c, 9).alias(c) for c in ("p_hat", "ci_low", "ci_high", "sbf_saturation", "evidence_score")], "cms_total", "cms_abnormal", "hll_estimate")


def _synthetic(spark: SparkSession) -> DataFrame:
    """The synthetic stream as records: regions with enough abnormal readings for alerts."""
    return sensors.synthetic(spark, CFG).withColumn("seq", F.col("i") + 1000 * F.substring("region", 2, 1).cast("long"))


@query
def alerts(spark: SparkSession, d: str) -> DataFrame:
    out = windows.alerts(windows.stage_stats(_synthetic(spark), CFG), CFG, now=1_700_000_000.0)
    metrics = [F.round(f"metrics.{c}", 9).alias(c) for c in ("p_hat", "ci_low", "ci_high", "heavy_bucket_ratio", "sbf_saturation")]
    limits = F.to_json("thresholds").alias("thresholds")
    return out.select("region", "window_id", "severity", F.round("score", 9).alias("score"), "reason", *metrics, *[F.col(f"metrics.{c}") for c in ("cms_total", "cms_abnormal", "hll_estimate")], _listed("metrics.heavy_buckets").alias("heavy_buckets"), limits, "timestamp")


@query
def alerts_after_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Regions that alert again: one last did within the cooldown, one at its end, one never."""
    last = spark.createDataFrame([("R3", 1_699_999_701.0), ("R3", 1_600_000_000.0), ("R2", 1_699_999_700.0)], "region string, timestamp double")
    cfg = replace(CFG, severities=(("critical", 0.75), ("high", 0.60), ("medium", 0.0)))
    return windows.alerts(windows.stage_stats(_synthetic(spark), CFG), cfg, now=1_700_000_000.0, last=last).select("region", "severity")


@query
def alerts_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Hours with a high abnormal rate, at most one for each region within six hours of the last one emitted."""
    hot = windows.tumbling(_records(spark, d), CFG, "1 hour").where(F.col("p_hat") >= 0.08).select("region", F.unix_timestamp("start").alias("ts_seconds"))
    return alerting.cooled(hot, replace(CFG, cooldown_seconds=21600))


@query
def window_stats_tumbling(spark: SparkSession, d: str) -> DataFrame:
    t = windows.tumbling(_records(spark, d), CFG, "1 hour")
    return t.select(F.unix_timestamp("start").alias("start"), "region", "cms_total", "cms_abnormal", *[F.round(c, 10).alias(c) for c in ("p_hat", "ci_low", "ci_high")])


@query
def landmark_stats(spark: SparkSession, d: str) -> DataFrame:
    t = windows.landmark(_records(spark, d), CFG, "1 day")
    return t.withColumn("start", F.unix_timestamp("start"))


@query
def latest_stats(spark: SparkSession, d: str) -> DataFrame:
    t = windows.tumbling(_records(spark, d), CFG, "1 day").select(F.unix_timestamp("start").alias("start"), "region", "cms_total", "cms_abnormal")
    return sensors.latest_per_region(t, "start")


@query
def compare_report(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    out = windows.compare(records, windows.window_stats(records, CFG), CFG)
    return out.select("region", "cms_total", "cms_abnormal", "exact_f2", "cms_total_diff", "cms_abnormal_diff", *[F.round(c, 10).alias(c) for c in ("p_hat_diff", "ci_low_diff", "ci_high_diff")], "hll_estimate_diff", F.round("heavy_bucket_ratio_diff", 10).alias("heavy_bucket_ratio_diff"), F.round("ams_f2_rel_err", 10).alias("ams_f2_rel_err"), F.round("hll_rel_err", 10).alias("hll_rel_err"), "counts_ok", "p_hat_ok", "ci_ok", "heavy_ratio_ok", "ams_f2_ok", "hll_ok", F.col("r_cms_total").alias("reported_total"), F.round("r_p_hat", 10).alias("reported_p_hat"), F.col("r_hll_estimate").alias("reported_devices"))


@query
def synthetic_stream(spark: SparkSession, d: str) -> DataFrame:
    s = sensors.synthetic(spark, CFG)
    return s.select("i", "region", "sensor_id", F.round("reading", 6).alias("reading"), F.round("confidence", 6).alias("confidence"), "note")


@query
def region_specs(spark: SparkSession, d: str) -> DataFrame:
    return sensors.region_specs(spark).select("region", "n", "anomaly_rate", "normal_mean", "normal_std", _listed("heavy_buckets"), "heavy_share")


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query
def sink_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Statistics written as JSON lines and read back."""
    from ..sources.sinks import JsonSink

    out = _scratch(spark, "jsonl")
    JsonSink(out).write_stats(windows.window_stats(_records(spark, d), CFG), "w")
    return _stats(sensors.read_reported_stats(spark, f"{out}/stats.jsonl"), "ams_f2")


@query
def sink_csv(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import CsvSink

    out = _scratch(spark, "csv")
    CsvSink(out).write_stats(windows.window_stats(_records(spark, d), CFG), "w")
    back = spark.read.option("header", True).csv(f"{out}/stats.csv")
    header = F.lit(",".join(back.columns)).alias("header")
    numbers = [F.round(F.col(c).cast("double"), 10).alias(c) for c in ("p_hat", "ci_low", "ci_high", "heavy_bucket_ratio", "ams_f2")]
    return back.select(header, "window_id", "region", *numbers, *[F.col(c).cast("long").alias(c) for c in ("cms_total", "cms_abnormal", "hll_estimate")], "heavy_buckets", *[F.coalesce(c, F.lit("")).alias(c) for c in ("sample_size", "sbf_saturation", "evidence_score")])


@query
def sensor_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out = _scratch(spark, "sensors")
    sensors.write_sensor_json(_records(spark, d).select("sensor_id", "region", "reading", "confidence", F.create_map(F.lit("seq"), F.col("seq").cast("string")).alias("metadata")), out)
    back = sensors.read_sensor_json(spark, out)
    return back.select(F.col("metadata")["seq"].cast("long").alias("seq"), "sensor_id", "region", "reading", "confidence")


@query
def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Hourly statistics from a stream of the events, run to its end; the same rows as window_stats_tumbling."""
    from ..streaming import windows as streams

    out = _scratch(spark, "stream")
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/stats")
    streams.run(streams.read_events(spark, f"{d}/events.parquet"), CFG, "1 hour", f"{out}/checkpoint", write).awaitTermination()
    t = spark.read.parquet(f"{out}/stats")
    return t.select(F.unix_timestamp("start").alias("start"), "region", "cms_total", "cms_abnormal", *[F.round(c, 10).alias(c) for c in ("p_hat", "ci_low", "ci_high")])


def _stream_to_end(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    out = _scratch(spark, "stream")
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows/batch=*")


@query
def sbf_stream(spark: SparkSession, d: str) -> DataFrame:
    """Suspects met again by a decaying filter for each region, as a stateful stream."""
    from ..streaming import state
    from ..streaming import windows as streams

    rows = rec.prepared(streams.read_events(spark, f"{d}/events.parquet"), CFG).where(rec.suspect(CFG))
    seen = _stream_to_end(spark, state.suspects_seen(rows, CFG), "append")
    return seen.select("region", "seq", "sensor_id", ((F.col("saturation") > 0) & (F.col("saturation") <= 1)).alias("filled"))


@query
def cooldown_stream(spark: SparkSession, d: str) -> DataFrame:
    """Times of abnormal readings for each region, at least six hours apart, as a stateful stream."""
    from ..streaming import state
    from ..streaming import windows as streams

    rows = rec.prepared(streams.read_events(spark, f"{d}/events.parquet"), CFG).where(rec.abnormal_device(CFG))
    hot = rows.select("region", F.unix_micros("ts").alias("us")).select("region", (F.col("us") / 1000000.0).alias("ts_seconds"))
    return _stream_to_end(spark, state.cooldown(hot, replace(CFG, cooldown_seconds=21600)), "append")


def _complete(spark: SparkSession, df: DataFrame) -> DataFrame:
    """All rows of a streaming aggregate after the last batch."""
    out = _scratch(spark, "stream")
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/rows")
    df.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query
def sliding_stream(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of two-hour windows, one beginning each hour, as a stream."""
    from ..streaming import windows as streams

    rows = _complete(spark, streams.window_histogram(streams.read_events(spark, f"{d}/events.parquet"), CFG, "2 hours", "1 hour"))
    return rows.select(F.unix_timestamp("start").alias("start"), "region", "bucket", "f")


@query
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each device's abnormal readings, at most two days apart, as a stream."""
    from ..streaming import windows as streams

    rows = _complete(spark, streams.session_counts(streams.read_events(spark, f"{d}/events.parquet"), CFG, "2 days"))
    return rows.select("sensor_id", F.unix_timestamp("start").alias("start"), "n")


@query
def device_sketch_stream(spark: SparkSession, d: str) -> DataFrame:
    """Distinct abnormal devices of each week by a HyperLogLog kept in a stream: within a tenth of the exact number."""
    from ..streaming import windows as streams

    rows = _complete(spark, streams.device_sketches(streams.read_events(spark, f"{d}/events.parquet"), CFG, "7 days"))
    exact = _records(spark, d).transform(lambda r: rec.prepared(r, CFG)).where(rec.abnormal_device(CFG)).groupBy(F.window("ts", "7 days")["start"].alias("start")).agg(F.count_distinct("sensor_id").alias("n"))
    both = exact.join(rows, "start")
    return both.select(F.unix_timestamp("start").alias("start"), "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.1 * F.col("n") + 0.5).alias("within"))


@query
def ams_by_window(spark: SparkSession, d: str) -> DataFrame:
    """Second moments that start anew with each window."""
    rows = _rows(spark, d).withColumn("start", F.unix_timestamp(F.window("ts", "7 days")["start"]))
    return ams.median_of_means(ams.accumulators(hist_ops.histogram(rows, "start"), CFG, "start"), CFG, "start")


@query
def row_counter(spark: SparkSession, d: str) -> DataFrame:
    """The number of records that a window's run has read, observed as they pass."""
    from pyspark.sql import Observation

    seen = Observation("window")
    rows = _rows(spark, d).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "window_count long")

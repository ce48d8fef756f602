"""Sensor records: from JSON lines, from an events table, and generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.hashing import gaussian, uniform

SENSOR = "sensor_id string, region string, reading double, confidence double, metadata map<string,string>"
STATS = (
    "region string, p_hat double, ci_low double, ci_high double, heavy_bucket_ratio double, heavy_buckets array<bigint>, "
    "cms_total bigint, cms_abnormal bigint, hll_estimate bigint, ams_f2 double, window_id string, write_ts double"
)
#: The regions of the synthetic stream (n, anomaly rate, mean, deviation, heavy buckets, their share).
REGION_SPECS = (("R2", 300, 0.25, 100.0, 15.0, [28, 29], 0.15), ("R3", 400, 0.70, 115.0, 12.0, [30], 0.40), ("R4", 250, 0.05, 80.0, 10.0, [], 0.0))


def read_sensor_json(spark: SparkSession, path: str) -> DataFrame:
    """Sensor records from JSON lines; malformed lines and absent required fields raise, absent metadata is empty."""
    rows = spark.read.schema(SENSOR).option("mode", "FAILFAST").json(path)
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a record lacks {c}")).cast(rows.schema[c].dataType)).alias(c)
    return rows.select(need("sensor_id"), need("region"), "reading", need("confidence"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def write_sensor_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_reported_stats(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """The last statistics row of each region by write time; no rows for a missing path, unless that must raise."""
    from pyspark.errors import AnalysisException

    try:
        return latest_per_region(spark.read.schema(STATS).json(path))
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], STATS)


def latest_per_region(stats: DataFrame, order: str = "write_ts") -> DataFrame:
    best = stats.groupBy("region").agg(F.max_by(F.struct(*[c for c in stats.columns if c != "region"]), F.col(order)).alias("r"))
    return best.select("region", "r.*")


def from_events(events: DataFrame) -> DataFrame:
    """seq, ts, region, sensor_id, reading, confidence of an events table."""
    region = F.when(F.col("event_type") == "error", "R3").when(F.col("event_type") == "purchase", "R2").when(F.col("event_type") == "view", "R4").when(F.col("event_type") == "signup", "R1").otherwise("R5")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("double")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        region.alias("region"),
        F.concat(region, F.lit("-D"), F.col("user_id")).alias("sensor_id"),
        F.when(F.col("event_id") % 33 != 0, F.col("value")).alias("reading"),
        (k / F.lit(100.0)).alias("confidence"),
    )


def region_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGION_SPECS), "region string, n int, anomaly_rate double, normal_mean double, normal_std double, heavy_buckets array<int>, heavy_share double")


def _in_bucket(bucket: Column, width: float, u: Column, jitter: Column) -> Column:
    """A reading within a bucket, moved by up to half a unit, which may leave the bucket."""
    return bucket * F.lit(width) + u * F.lit(width) + (jitter * F.lit(1.0) - F.lit(0.5))


def synthetic(spark: SparkSession, cfg: Config, seed: int = 2026, pool: int = 300, missing: float = 0.03, corrupted: float = 0.02, low_conf: float = 0.10, high_conf_share: float = 0.70) -> DataFrame:
    """A reproducible stream: each draw of record i of a region has a uniform of its own, from (seed, region, i, purpose).

    Columns: i, region, sensor_id, reading, confidence, note; in shuffled order (``place``)."""
    t, width = cfg.anomaly_reading, cfg.bucket_width
    u = lambda purpose: uniform(seed, F.col("region"), F.col("i"), purpose)
    between = lambda purpose, a, b: F.lit(a) + u(purpose) * F.lit(b - a)
    rows = region_specs(spark).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("anomaly", u("anomaly") < F.col("anomaly_rate"))
    conf = F.when(F.col("anomaly"), F.when(u("confident") < high_conf_share, between("conf", 0.70, 0.95)).otherwise(between("conf", 0.10, 0.55))).otherwise(between("conf", 0.60, 0.97))
    forced = u("low") < low_conf
    gone, bad = u("missing") < missing, u("corrupted") < corrupted
    heavy_n = F.size("heavy_buckets")
    pick = F.get("heavy_buckets", F.floor(u("pick") * heavy_n).cast("int"))
    share = F.when(F.col("anomaly"), F.col("heavy_share")).otherwise(F.lit(0.2) * F.col("heavy_share"))
    heavy = (heavy_n > 0) & (u("heavy") < share)
    z = gaussian(seed, F.col("region"), F.col("i"), "normal")
    plain = F.when(F.col("anomaly"), F.lit(t) + F.abs(F.lit(5.0) + F.lit(8.0) * z)).otherwise(F.col("normal_mean") + F.col("normal_std") * z)
    reading = F.when(heavy, _in_bucket(pick, width, u("inside"), u("jitter"))).otherwise(plain)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(2.0 * t), reading))
    spoilt = F.when(u("spoilt") >= 0.5, between("garbage", 0.0, 1.3 * t))
    note = F.concat(F.when(forced, "forced_low_conf").otherwise(""), F.when(gone, "|missing").when(bad, "|corrupted").otherwise(""))
    return rows.select(
        "i",
        "region",
        F.concat("region", F.lit("-D"), (F.floor(u("device") * pool) + 1).cast("string")).alias("sensor_id"),
        F.when(gone, F.lit(None).cast("double")).when(bad, spoilt).otherwise(clipped).alias("reading"),
        F.when(forced, F.least(conf, between("lowered", 0.05, 0.40))).otherwise(conf).alias("confidence"),
        note.alias("note"),
        u("place").alias("place"),
    )



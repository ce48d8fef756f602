"""Per-record operators: imputation, buckets, risk, features and predicates. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def by_region(values: dict[str, float], default: float) -> Column:
    out = None
    for region, value in values.items():
        out = (F if out is None else out).when(F.col("region") == region, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def impute(records: DataFrame, cfg: Config) -> DataFrame:
    """reading_hat: the reading, or its region's constant where there is none."""
    return records.withColumn("reading_hat", F.coalesce(F.col("reading"), by_region(cfg.fallback, cfg.default_fallback)))


def bucket_of(x: Column, width: float) -> Column:
    """x // width for any positive width, from the exact remainder (a rounded quotient may miss by one); null for NaN and
    infinities."""
    w = F.lit(float(width))
    rest = x % w
    quotient = (x - rest) / w - F.when(rest < 0, 1.0).otherwise(0.0)
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, F.round(quotient).cast("long"))


def bucketize(imputed: DataFrame, cfg: Config) -> DataFrame:
    return imputed.withColumn("bucket", bucket_of(F.col("reading_hat"), cfg.bucket_width))


def score(imputed: DataFrame, cfg: Config) -> DataFrame:
    """risk (of the region) and score: reading, confidence and risk multiplied."""
    return imputed.withColumn("risk", by_region(cfg.risk, cfg.default_risk)).withColumn("score", F.col("reading_hat") * F.col("confidence") * F.col("risk"))


def features_a() -> Column:
    return F.array("reading_hat", "confidence", F.lit(0.0), "risk")


def features_b() -> Column:
    return F.array("reading_hat", "confidence", "risk", F.lit(0.0))


def abnormal_bucket(cfg: Config) -> Column:
    """The bucket's lower edge reaches the threshold."""
    return F.col("bucket") * F.lit(cfg.bucket_width) >= F.lit(cfg.anomaly_reading)


def abnormal_device(cfg: Config) -> Column:
    """The reading lies above the threshold, with enough confidence."""
    return (F.col("reading_hat") > cfg.anomaly_reading) & (F.col("confidence") >= cfg.min_confidence)


def abnormal_sample(cfg: Config, min_confidence: float | None) -> Column:
    """The reading reaches the threshold; confidence counts where a minimum is given."""
    hit = F.col("reading_hat") >= cfg.anomaly_reading
    return hit if min_confidence is None else hit & (F.col("confidence") >= min_confidence)


def suspect(cfg: Config) -> Column:
    return (F.col("confidence") <= cfg.suspect_confidence) & (F.col("reading_hat") >= cfg.anomaly_reading)


def prepared(records: DataFrame, cfg: Config) -> DataFrame:
    return score(bucketize(impute(records, cfg), cfg), cfg)

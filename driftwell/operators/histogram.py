"""Region histograms and what follows from them. Everything downstream works on (region, bucket) counts, not records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.intervals import wilson


def histogram(bucketed: DataFrame, *keys: str) -> DataFrame:
    """(keys, region, bucket, f): partial counts in each task, one small shuffle."""
    return bucketed.groupBy(*keys, "region", "bucket").agg(F.count("*").alias("f"))


def regions(df: DataFrame, cfg: Config) -> DataFrame:
    return df.sparkSession.createDataFrame([(r,) for r in cfg.regions], "region string")


def totals(hist: DataFrame, cfg: Config, *keys: str, whole: bool = False) -> DataFrame:
    """cms_total and cms_abnormal over buckets 0 to max_bucket, or over all buckets (whole)."""
    hist = hist.where(F.col("region").isin(*cfg.regions))
    inside = F.lit(True) if whole else F.col("bucket").between(0, cfg.max_bucket)
    high = F.col("bucket") * F.lit(cfg.bucket_width) >= F.lit(cfg.anomaly_reading)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("f"))), F.lit(0)).alias
    return hist.groupBy(*keys, "region").agg(count(inside)("cms_total"), count(inside & high)("cms_abnormal"))


def zero_rows(per_region: DataFrame, cfg: Config, *columns: str) -> DataFrame:
    """Every configured region has a row: absent ones zeros; others are dropped."""
    joined = regions(per_region, cfg).join(per_region, "region", "left")
    return joined.select("region", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def heavy(hist: DataFrame, cfg: Config, *keys: str) -> DataFrame:
    """heavy_buckets (ascending) and heavy_bucket_ratio: buckets with at least a set share of the region's total."""
    inside = hist.where(F.col("bucket").between(0, cfg.max_bucket) & F.col("region").isin(*cfg.regions))
    whole = inside.groupBy(*keys, "region").agg(F.sum("f").alias("total"))
    share = F.col("f") / F.col("total") >= F.lit(cfg.heavy_ratio)
    per = inside.join(whole, [*keys, "region"]).groupBy(*keys, "region").agg(F.sort_array(F.collect_list(F.when(share, F.col("bucket")))).alias("heavy_buckets"))
    return per.withColumn("heavy_bucket_ratio", F.size("heavy_buckets") / F.lit(float(cfg.max_bucket + 1)))


def exact_f2(hist: DataFrame) -> DataFrame:
    return hist.groupBy("region").agg(F.sum(F.col("f") * F.col("f")).alias("exact_f2"))


def with_wilson(per_region: DataFrame, alpha: float) -> DataFrame:
    p, low, high = wilson(F.col("cms_abnormal"), F.col("cms_total"), alpha)
    return per_region.withColumns({"p_hat": p, "ci_low": low, "ci_high": high})

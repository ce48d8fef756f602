"""Distinct anomalous devices: exact, by grouping sets, and by a mergeable sketch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_all(devices: DataFrame) -> DataFrame:
    """One row: hll_estimate, the exact number over all regions."""
    return devices.agg(F.countDistinct("sensor_id").alias("hll_estimate"))


def distinct_by_region(devices: DataFrame) -> DataFrame:
    """(region, n): each region and, with a null region, all of them."""
    return devices.groupingSets([[F.col("region")], []], F.col("region")).agg(F.countDistinct("sensor_id").alias("n"))


def sketch(devices: DataFrame, *keys: str, lg_k: int = 12) -> DataFrame:
    """(keys, sketch): a HyperLogLog of the devices, to be stored and merged."""
    return devices.groupBy(*keys).agg(F.hll_sketch_agg("sensor_id", F.lit(lg_k)).alias("sketch"))


def merged_estimate(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))

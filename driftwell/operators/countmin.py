"""Count-min sketches of histograms. The standard update is linear, so the sketch is a grouped sum over distinct keys."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.hashing import bits52, digest


def geometry(cfg: Config) -> tuple[int, int]:
    """(width, depth)."""
    return math.ceil(math.e / cfg.cms_epsilon), math.ceil(math.log(1.0 / cfg.cms_delta))


def _column(row: Column, width: int) -> Column:
    return bits52(digest("cms", row, F.col("region"), F.col("bucket"))) % width


def positions(keys: DataFrame, cfg: Config) -> DataFrame:
    """keys with one row for each row of the sketch: row, col."""
    width, depth = geometry(cfg)
    spread = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return spread.withColumn("col", _column(F.col("row"), width))


def cells(hist: DataFrame, cfg: Config) -> DataFrame:
    """(row, col, cnt): the cells that are not zero."""
    return positions(hist, cfg).groupBy("row", "col").agg(F.sum("f").alias("cnt"))


def query(keys: DataFrame, table: DataFrame, cfg: Config) -> DataFrame:
    """estimate for each (region, bucket) of keys: the least of its cells."""
    at = positions(keys.select("region", "bucket").distinct(), cfg)
    return at.join(table, ["row", "col"], "left").groupBy("region", "bucket").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def conservative(hist: DataFrame, cfg: Config, shards: int = 1) -> DataFrame:
    """(region, bucket, f, estimate) under conservative update.

    The result depends on order and cannot be merged, so one task folds the histogram in order of region and bucket. Its
    rows are as many as there are buckets, not records. With more shards each has a sketch of its own.
    """
    rows = positions(hist, cfg).groupBy("region", "bucket", "f").agg(F.sort_array(F.collect_list(F.struct("row", "col"))).alias("at"))
    rows = rows.select("region", "bucket", "f", F.transform("at", lambda x: x["col"]).alias("cols"), F.pmod(F.xxhash64("region"), F.lit(shards)).alias("shard"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["region", "bucket"])
        table: dict[tuple[int, int], int] = {}
        keys = [list(enumerate(cols)) for cols in pdf["cols"]]
        for key, f in zip(keys, pdf["f"]):
            floor = min(table.get(c, 0) for c in key) + int(f)
            for c in key:
                table[c] = max(table.get(c, 0), floor)
        return pdf[["region", "bucket", "f"]].assign(estimate=[min(table[c] for c in key) for key in keys])

    return rows.groupBy("shard").applyInPandas(fold, "region string, bucket long, f long, estimate long")


def builtin(records: DataFrame, cfg: Config) -> DataFrame:
    """Spark's own sketch as a binary column, for storage; it has another geometry and no point query in SQL."""
    key = F.concat_ws(":", "region", "bucket")
    return records.agg(F.count_min_sketch(key, F.lit(cfg.cms_epsilon), F.lit(1.0 - cfg.cms_delta), F.lit(1)).alias("sketch"))

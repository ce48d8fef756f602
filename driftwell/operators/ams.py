"""AMS sketches of the second moment. Linear in the frequencies, so computed on the histogram."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..config import Config
from ..functions.hashing import sign


@F.pandas_udf(IntegerType())
def blake_sign(key: pd.Series) -> pd.Series:
    """The sign of ``seed:j:region:bucket`` by BLAKE2s, for a few thousand distinct keys."""
    return key.map(lambda k: 1 - 2 * (hashlib.blake2s(k.encode(), digest_size=8).digest()[-1] & 1)).astype("int32")


def accumulators(hist: DataFrame, cfg: Config, *keys: str, blake: bool = False) -> DataFrame:
    """(keys, region, j, z): the signed sum of frequencies for each sketch."""
    spread = hist.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cfg.ams_sketches - 1))))
    parts = F.concat_ws(":", F.lit(str(cfg.ams_seed)), "j", "region", "bucket")
    s = blake_sign(parts) if blake else sign(parts)
    return spread.groupBy(*keys, "region", "j").agg(F.sum(s * F.col("f")).alias("z"))


def median_of_means(acc: DataFrame, cfg: Config, *keys: str) -> DataFrame:
    """(keys, region, ams_f2): squares in contiguous groups, the last with the rest; the median of their means."""
    n, g = cfg.ams_sketches, cfg.ams_groups
    if g <= 1 or n < g:
        return mean(acc, *keys)
    group = F.least(F.floor(F.col("j") / (n // g)), F.lit(g - 1))
    means = acc.groupBy(*keys, "region", group.alias("g")).agg(F.avg((F.col("z") * F.col("z")).cast("double")).alias("m"))
    return means.groupBy(*keys, "region").agg(F.median("m").alias("ams_f2"))


def mean(acc: DataFrame, *keys: str) -> DataFrame:
    return acc.groupBy(*keys, "region").agg(F.avg((F.col("z") * F.col("z")).cast("double")).alias("ams_f2"))

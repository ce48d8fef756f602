"""Weighted reservoirs, weighted choice and bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.hashing import open_uniform, uniform
from ..functions.intervals import quantile
from .records import abnormal_sample


def keyed(scored: DataFrame, seed: int, weight: str = "score") -> DataFrame:
    """Rows of positive weight with their key ln(u)/w: the same order as u^(1/w), without underflow."""
    return scored.where(F.col(weight) > 0).withColumn("key", F.ln(open_uniform(seed, "reservoir", F.col("seq"))) / F.col(weight))


def reservoir(scored: DataFrame, k: int, seed: int = 0, weight: str = "score") -> DataFrame:
    """The k rows of the greatest keys, in falling order: each task keeps k, then they are merged."""
    return keyed(scored, seed, weight).orderBy(F.desc("key"), "seq").limit(k)


def reservoir_by(scored: DataFrame, group: str, k: int, seed: int = 0, weight: str = "score") -> DataFrame:
    """k rows for each group with their place; ranks are limited before the shuffle."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("key"), "seq"))
    return keyed(scored, seed, weight).withColumn("place", place).where(F.col("place") <= k)


def weighted_choice(sample: DataFrame, draws: int, seed: int) -> DataFrame:
    """(region, draw, seq): for each draw the first row whose cumulative weight reaches it, the last one failing that."""
    order = W.partitionBy("region").orderBy("place")
    total = F.sum("score").over(W.partitionBy("region"))
    rows = sample.withColumn("upto", F.sum("score").over(order.rowsBetween(W.unboundedPreceding, 0)) / total)
    rows = rows.withColumn("from", F.coalesce(F.lag("upto").over(order), F.lit(-1.0))).withColumn("last", F.lead("seq").over(order).isNull())
    each = rows.select("region").distinct().select("region", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    each = each.withColumn("r", uniform(seed, "choice", F.col("region"), F.col("draw")))
    hit = (F.col("r") > F.col("from")) & ((F.col("r") <= F.col("upto")) | F.col("last"))
    return each.join(rows, "region").where(hit).select("region", "draw", "seq")


def expectation(sample: DataFrame, cfg: Config, min_confidence: float | None = None) -> DataFrame:
    """(region, n, p): the weighted share of abnormal rows, which a bootstrap replicate has as its mean."""
    w = F.greatest("score", F.lit(0.0))
    hit = F.when(abnormal_sample(cfg, min_confidence), w).otherwise(0.0)
    per = sample.groupBy("region").agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(hit).alias("h"))
    return per.select("region", "n", F.when(F.col("w") > 0, F.col("h") / F.col("w")).otherwise(0.0).alias("p"))


def bootstrap(sample: DataFrame, cfg: Config, min_confidence: float | None = None) -> DataFrame:
    """(region, n, p_hat, ci_low, ci_high): replicates of n weighted draws each. Only whether a draw is abnormal counts,
    so a draw is a uniform against the weighted share; replicates are counted in each task before they meet."""
    p = expectation(sample, cfg, min_confidence)
    b = p.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(cfg.bootstrap_replicates)))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    hit = uniform(cfg.bootstrap_seed, F.col("region"), F.col("b"), F.col("i")) <= F.col("p")
    share = b.groupBy("region", "n", "b").agg((F.sum(hit.cast("int")) / F.col("n")).alias("share"))
    return share.groupBy("region", "n").agg(F.avg("share").alias("p_hat"), quantile(F.col("share"), cfg.alpha / 2).alias("ci_low"), quantile(F.col("share"), 1 - cfg.alpha / 2).alias("ci_high"))

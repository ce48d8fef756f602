"""Window statistics: sketches only, sketches with signatures, and the staged variant with evidence and alerts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..operators import ams, bloom, distinct, lsh, sampling
from ..operators.alerts import after_cooldown, candidates, evidence
from ..operators.histogram import exact_f2, heavy, histogram, regions, totals, with_wilson
from ..operators.records import abnormal_device, features_b, prepared, suspect


def _per_region(hist: DataFrame, cfg: Config) -> DataFrame:
    """A row for each configured region with totals, interval and heavy buckets. Small tables from here on."""
    base = regions(hist, cfg).join(totals(hist, cfg), "region", "left").join(heavy(hist, cfg), "region", "left")
    filled = base.select(
        "region",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("cms_total", "cms_abnormal")],
        F.coalesce("heavy_buckets", F.array().cast("array<bigint>")).alias("heavy_buckets"),
        F.coalesce("heavy_bucket_ratio", F.lit(0.0)).alias("heavy_bucket_ratio"),
    )
    return with_wilson(filled, cfg.alpha)


def window_stats(records: DataFrame, cfg: Config) -> DataFrame:
    """The flagship: one row for each region, from one pass over the records for counts and one for devices."""
    rows = prepared(records, cfg)
    hist = histogram(rows)
    devices = distinct.distinct_all(rows.where(abnormal_device(cfg)))
    f2 = ams.median_of_means(ams.accumulators(hist.where(F.col("region").isin(*cfg.regions)), cfg), cfg)
    joined = _per_region(hist, cfg).join(f2, "region", "left").withColumn("ams_f2", F.coalesce("ams_f2", F.lit(0.0)))
    return joined.crossJoin(F.broadcast(devices)).select("region", "p_hat", "ci_low", "ci_high", "heavy_bucket_ratio", "heavy_buckets", "cms_total", "cms_abnormal", "hll_estimate", "ams_f2")


def window_stats_lsh(records: DataFrame, cfg: Config, min_size: int = 3, top_k: int = 10) -> DataFrame:
    """Window statistics with a mean-of-squares moment and the largest signature buckets on each row."""
    rows = prepared(records, cfg)
    hist = histogram(rows)
    f2 = ams.mean(ams.accumulators(hist.where(F.col("region").isin(*cfg.regions)), cfg))
    signed = lsh.signatures(rows.withColumn("features", features_b()), cfg, 4)
    big = lsh.bucket_stats(signed, 4, min_size, top_k)
    order = F.struct((-F.col("size")).alias("o"), "table_idx", "first", "signature", "size", "means", "example_ids")
    listed = big.agg(F.transform(F.sort_array(F.collect_list(order)), lambda b: F.struct(b["table_idx"].alias("table_idx"), b["signature"].alias("signature"), b["size"].alias("size"), b["means"].alias("means"), b["example_ids"].alias("example_ids"))).alias("lsh_big_buckets"))
    devices = distinct.distinct_all(rows.where(abnormal_device(cfg)))
    joined = _per_region(hist, cfg).join(f2, "region", "left").withColumn("ams_f2", F.coalesce("ams_f2", F.lit(0.0)))
    return joined.crossJoin(F.broadcast(devices)).crossJoin(F.broadcast(listed))


def stage_stats(records: DataFrame, cfg: Config, sample_size: int | None = None) -> DataFrame:
    """Statistics with bootstrap intervals where the sample suffices, Bloom saturation and an evidence score."""
    rows = prepared(records, cfg)
    hist = histogram(rows)
    sample = sampling.reservoir(rows, sample_size or cfg.reservoir_size).where(F.col("region").isin(*cfg.regions))
    boot = sampling.bootstrap(sample, cfg).select("region", F.col("n").alias("sample_size"), F.col("p_hat").alias("bp"), F.col("ci_low").alias("bl"), F.col("ci_high").alias("bh"))
    joined = _per_region(hist, cfg).join(boot, "region", "left").withColumn("sample_size", F.coalesce("sample_size", F.lit(0)))
    enough = F.col("sample_size") >= cfg.bootstrap_min_n
    for name, own in (("p_hat", "bp"), ("ci_low", "bl"), ("ci_high", "bh")):
        joined = joined.withColumn(name, F.when(enough, F.col(own)).otherwise(F.col(name)))
    devices = distinct.distinct_all(rows.where(abnormal_device(cfg)))
    filled = bloom.saturation(rows.where(suspect(cfg)), cfg)
    return evidence(joined.drop("bp", "bl", "bh").crossJoin(F.broadcast(devices)).crossJoin(F.broadcast(filled)))


def alerts(stats: DataFrame, cfg: Config, window_id: str = "w", now: float | None = None, last: DataFrame | None = None) -> DataFrame:
    """Alert rows with their metrics, greatest score first. now: seconds, the clock's if not given; last: earlier alerts
    (region, timestamp), within whose cooldown a region stays silent."""
    now = time.time() if now is None else float(now)
    metrics = F.struct("p_hat", "ci_low", "ci_high", "cms_total", "cms_abnormal", "heavy_buckets", "heavy_bucket_ratio", "hll_estimate", "sbf_saturation")
    # The names of the limits, in order.
    names = ("min_cms_total", "min_sample_size_for_alert", "min_ci_lower", "min_p_hat", "min_evidence_score", "min_heavy_buckets", "min_hll_estimate")
    limits = F.struct(*[F.lit(getattr(cfg, c)).alias(c) for c in names], F.struct(*[F.lit(v).alias(k) for k, v in cfg.severities]).alias("severity_thresholds"))
    rows = after_cooldown(candidates(stats, cfg), cfg, now, last)
    out = rows.select("region", F.lit(window_id).alias("window_id"), "severity", F.col("evidence_score").alias("score"), "reason", metrics.alias("metrics"), limits.alias("thresholds"), F.lit(now).alias("timestamp"))
    return out.orderBy(F.desc("score"), "region")


def tumbling(records: DataFrame, cfg: Config, width: str) -> DataFrame:
    """(start, region, cms_total, cms_abnormal, p_hat, ci_low, ci_high) of each window that has records."""
    rows = prepared(records, cfg).withColumn("start", F.window("ts", width)["start"])
    return with_wilson(totals(histogram(rows, "start"), cfg, "start"), cfg.alpha)


def landmark(records: DataFrame, cfg: Config, width: str) -> DataFrame:
    """(start, region, cms_total, cms_abnormal, devices): totals since the beginning, and devices first seen by then."""
    rows = prepared(records, cfg).withColumn("start", F.window("ts", width)["start"])
    upto = W.partitionBy("region").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    per = totals(histogram(rows, "start"), cfg, "start")
    first = rows.where(abnormal_device(cfg)).groupBy("sensor_id").agg(F.min("start").alias("start"))
    new = first.groupBy("start").agg(F.count("*").alias("new"))
    # One row for each window: the running count over all of them is as long as the number of windows.
    starts = per.select("start").distinct().join(new, "start", "left").select("start", F.coalesce("new", F.lit(0)).alias("new"))
    seen = starts.select("start", F.sum("new").over(W.orderBy("start").rowsBetween(W.unboundedPreceding, 0)).alias("devices"))
    run = per.select("start", "region", *[F.sum(c).over(upto).alias(c) for c in ("cms_total", "cms_abnormal")])
    return run.join(seen, "start")


def compare(records: DataFrame, reported: DataFrame, cfg: Config) -> DataFrame:
    """Exact metrics of every region beside the reported ones, their differences and whether they agree."""
    rows = prepared(records, cfg)
    hist = histogram(rows)
    ref = with_wilson(regions(hist, cfg).join(totals(hist, cfg, whole=True), "region", "left").join(heavy_all(hist, cfg), "region", "left").join(exact_f2(hist), "region", "left").fillna(0, ["cms_total", "cms_abnormal", "heavy_bucket_ratio", "exact_f2"]), cfg.alpha)
    devices = distinct.distinct_all(rows.where(abnormal_device(cfg))).withColumnRenamed("hll_estimate", "devices")
    ref = ref.crossJoin(F.broadcast(devices))
    own = reported.select("region", *[F.col(c).alias(f"r_{c}") for c in ("cms_total", "cms_abnormal", "p_hat", "ci_low", "ci_high", "heavy_buckets", "heavy_bucket_ratio", "hll_estimate", "ams_f2")])
    j = ref.join(own, "region", "left")
    pairs = (("cms_total", "cms_total"), ("cms_abnormal", "cms_abnormal"), ("p_hat", "p_hat"), ("ci_low", "ci_low"), ("ci_high", "ci_high"), ("heavy_bucket_ratio", "heavy_bucket_ratio"), ("devices", "hll_estimate"), ("exact_f2", "ams_f2"))
    diff = {f"{r}_diff": F.col(c) - F.coalesce(F.col(f"r_{r}"), F.lit(0)) for c, r in pairs}
    j = j.withColumns(diff)
    rel = lambda d, c: F.when(F.col(c) > 0, F.abs(F.col(d)) / F.col(c)).otherwise(0.0)
    j = j.withColumns({"ams_f2_rel_err": rel("ams_f2_diff", "exact_f2"), "hll_rel_err": rel("hll_estimate_diff", "devices")})
    return j.withColumns({
        "counts_ok": (F.col("cms_total_diff") == 0) & (F.col("cms_abnormal_diff") == 0),
        "p_hat_ok": F.abs("p_hat_diff") <= 1e-9,
        "ci_ok": (F.abs("ci_low_diff") <= 1e-6) & (F.abs("ci_high_diff") <= 1e-6),
        "heavy_ratio_ok": F.abs("heavy_bucket_ratio_diff") <= 1e-9,
        "ams_f2_ok": F.col("ams_f2_rel_err") <= 0.15,
        "hll_ok": F.col("hll_rel_err") <= 0.30,
    }).orderBy("region")


def nested(report: DataFrame) -> DataFrame:
    """The rows of compare() as (region, ref, reported, diffs, status), the layout of a report file. All names, in order."""
    measures = ("cms_total", "cms_abnormal", "p_hat", "ci_low", "ci_high", "heavy_buckets", "heavy_bucket_ratio", "hll_estimate", "ams_f2")
    own = {"hll_estimate": ("devices", "hll_estimate(ref_global)"), "ams_f2": ("exact_f2", "ams_f2")}
    ref = [F.col(own.get(c, (c, c))[0]).alias(own.get(c, (c, c))[1]) for c in measures]
    diffs = [f"{c}_diff" for c in measures if c != "heavy_buckets"]
    status = ("counts_ok", "p_hat_ok", "ci_ok", "heavy_ratio_ok", "ams_f2_ok", "ams_f2_rel_err", "hll_ok", "hll_rel_err")
    return report.select("region", F.struct(*ref).alias("ref"), F.struct(*[F.col(f"r_{c}").alias(c) for c in measures]).alias("reported"), F.struct(*diffs).alias("diffs"), F.struct(*status).alias("status")).orderBy("region")


def heavy_all(hist: DataFrame, cfg: Config) -> DataFrame:
    """heavy() with shares of the region's whole total, as the comparison counts it."""
    mine = hist.where(F.col("region").isin(*cfg.regions))
    whole = mine.groupBy("region").agg(F.sum("f").alias("total"))
    share = (F.col("f") / F.col("total") >= F.lit(cfg.heavy_ratio)) & F.col("bucket").between(0, cfg.max_bucket)
    per = mine.join(whole, "region").groupBy("region").agg(F.sort_array(F.collect_list(F.when(share, F.col("bucket")))).alias("heavy_buckets"))
    return per.withColumn("heavy_bucket_ratio", F.size("heavy_buckets") / F.lit(float(cfg.max_bucket + 1)))

"""Evidence scores, alert rules and cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def evidence(stats: DataFrame) -> DataFrame:
    """evidence_score from p_hat, cms_total, cms_abnormal, hll_estimate and sbf_saturation."""
    share = F.when(F.col("cms_total") > 0, F.col("cms_abnormal") / F.col("cms_total")).otherwise(0.0)
    spread = F.least(F.lit(1.0), F.col("hll_estimate") / F.greatest(F.lit(1), "cms_total"))
    return stats.withColumn("evidence_score", F.lit(0.4) * F.col("p_hat") + F.lit(0.25) * share + F.lit(0.2) * spread + F.lit(0.15) * F.col("sbf_saturation"))


def severity(score: Column, cfg: Config) -> Column:
    out = None
    for name, least in cfg.severities:
        out = (F if out is None else out).when(score >= least, name)
    return out


def reason(cfg: Config) -> Column:
    """The wording of the parts, which downstream readers parse."""
    three = lambda c: F.format_string("%.3f", c)
    over = lambda label, c, least: F.when(F.col(c) >= least, F.concat(F.lit(label), three(F.col(c)), F.lit(f"≥{least:.3f}")))
    parts = [
        over("CI下界 ", "ci_low", cfg.min_ci_lower),
        over("比例 p̂=", "p_hat", cfg.min_p_hat),
        F.when(F.col("n_heavy") >= cfg.min_heavy_buckets, F.concat(F.lit("重频桶 "), F.col("n_heavy"), F.lit(" 个"))),
        F.when(F.col("hll_estimate") >= cfg.min_hll_estimate, F.concat(F.lit("HLL异常设备数 "), F.col("hll_estimate"), F.lit(f"≥{cfg.min_hll_estimate}"))),
        over("综合分数 ", "evidence_score", cfg.min_evidence_score),
    ]
    joined = F.concat_ws("；", *parts)
    return F.when(joined == "", "综合规则触发").otherwise(joined)


def candidates(stats: DataFrame, cfg: Config) -> DataFrame:
    """Rows of stats that reach the alert line: severity, reason and n_heavy are added. Cooldown comes after."""
    rows = stats.withColumn("n_heavy", F.size("heavy_buckets"))
    hit = (F.col("ci_low") >= cfg.min_ci_lower) | ((F.col("p_hat") >= cfg.min_p_hat) & (F.col("n_heavy") >= cfg.min_heavy_buckets))
    hit = hit | ((F.col("evidence_score") >= cfg.min_evidence_score) & (F.col("hll_estimate") >= cfg.min_hll_estimate))
    if cfg.strict_gates:
        hit = hit & (F.col("cms_total") >= cfg.min_cms_total) & (F.col("sample_size") >= cfg.min_sample_size_for_alert)
    return rows.withColumns({"severity": severity(F.col("evidence_score"), cfg), "reason": reason(cfg)}).where(hit & F.col("severity").isNotNull())


def after_cooldown(rows: DataFrame, cfg: Config, now: float, last: DataFrame | None = None) -> DataFrame:
    """rows whose region last had an alert (last: region, timestamp; none: never) cooldown_seconds before now or earlier."""
    if last is None:
        return rows.where(F.lit(float(now)) >= cfg.cooldown_seconds)
    latest = last.groupBy("region").agg(F.max("timestamp").cast("double").alias("_last"))
    known = rows.join(latest, "region", "left")
    return known.where(F.lit(float(now)) - F.coalesce("_last", F.lit(0.0)) >= cfg.cooldown_seconds).drop("_last")


def cooled(alerts: DataFrame, cfg: Config, ts: str = "ts_seconds") -> DataFrame:
    """Alerts that come at least cooldown_seconds after the last one *emitted* for their region (in order of ts).

    What is emitted depends on what was emitted before, so each region's candidate times, a window each, are folded in order.
    """
    times = alerts.groupBy("region").agg(F.sort_array(F.collect_set(ts)).alias("times"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("kept"))

    def step(s: Column, t: Column) -> Column:
        ok = s["last"].isNull() | (t - s["last"] >= cfg.cooldown_seconds)
        return F.struct(F.when(ok, t).otherwise(s["last"]).alias("last"), F.when(ok, F.concat(s["kept"], F.array(t))).otherwise(s["kept"]).alias("kept"))

    kept = times.select("region", F.explode(F.aggregate(F.transform("times", lambda t: t.cast("double")), start, step, lambda s: s["kept"])).alias("_t"))
    return alerts.join(kept, (alerts["region"] == kept["region"]) & (alerts[ts].cast("double") == kept["_t"]), "left_semi")

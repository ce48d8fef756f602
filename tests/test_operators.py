import math
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.config import Config, from_dict
from driftwell.functions import intervals
from driftwell.operators import ams, bloom, countmin, histogram, records, sampling
from driftwell.operators import alerts as alerting
from driftwell.plans import windows
from driftwell.sources import sensors, sinks
from driftwell.streaming.state import StableBloom, bloom_positions

CFG = Config()


def test_published_intervals(spark):
    rows = spark.createDataFrame([(66, 300), (279, 400), (13, 250), (0, 0), (5, -1)], "k long, n long")
    p, low, high = intervals.wilson(F.col("k"), F.col("n"), 0.05)
    got = [tuple(r) for r in rows.select(p, low, high).collect()]
    assert got == [(0.22, 0.17682744565907954, 0.2702526183369473), (0.6975, 0.6507820074415556, 0.7404606362376861), (0.052, 0.030637655038217734, 0.08692178152037365), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_interval_as_sql_function(spark):
    intervals.register(spark)
    assert tuple(spark.sql("select wilson_low(66, 300), wilson_high(66, 300), wilson_low(0, 0)").first()) == (0.17682744565907954, 0.2702526183369473, 0.0)


def test_alpha():
    assert (intervals.z_score(0.05), intervals.z_score(0.10), intervals.z_score(0.2)) == (1.959964, 1.644854, 1.959964)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1000, 1000), min_size=1, max_size=60), st.sampled_from([5.0, 0.1, 0.5, 7.0]))
def test_buckets_floor(spark, xs, width):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(records.bucket_of(F.col("x"), width)).collect()]
    assert got == [int(x // width) for x in xs]


def test_bucket_of_no_number(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (None,), (-0.1,), (145.0,), (205.0,)], "x double")
    assert [r[0] for r in rows.select(records.bucket_of(F.col("x"), 5.0)).collect()] == [None, None, None, None, -1, 29, 41]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30), st.sampled_from([0.0, 0.025, 0.5, 0.975, 1.0]))
def test_quantile(spark, xs, q):
    got = spark.createDataFrame([(x,) for x in xs], "x double").agg(intervals.quantile(F.col("x"), q)).first()[0]
    xs, pos = sorted(xs), q * (len(xs) - 1)
    i = int(pos)
    want = xs[i] if i + 1 == len(xs) else xs[i] + (xs[i + 1] - xs[i]) * (pos - i)
    assert got == pytest.approx(want, abs=1e-12)


SAMPLES = [("S201", "R2", 57.0, 0.91), ("S203", "R2", 149.0, 0.18), ("S204", "R3", None, 0.88), ("S211", "R2", 96.0, 0.80), ("S1", "R4", 145.0, 0.60), ("S2", "R9", 300.0, 0.9)]


@pytest.fixture
def sample(spark):
    rows = spark.createDataFrame(SAMPLES, "sensor_id string, region string, reading double, confidence double")
    return records.prepared(rows, CFG)


def test_worked_records(sample):
    by = {r.sensor_id: r for r in sample.withColumns({"device": records.abnormal_device(CFG), "suspect": records.suspect(CFG), "edge": records.abnormal_bucket(CFG)}).collect()}
    assert by["S204"].reading_hat == 151.0 and by["S204"].bucket == 30 and by["S204"].device and by["S204"].score == pytest.approx(172.744)
    assert by["S203"].bucket == 29 and by["S203"].suspect and not by["S203"].device and by["S203"].score == pytest.approx(32.184)
    assert by["S211"].bucket == 19 and not by["S211"].device
    assert by["S1"].edge and not by["S1"].device  # 145 meets the bucket's edge, but does not lie above


def test_totals_leave_out_of_range(sample):
    hist = histogram.histogram(sample)
    got = {r.region: (r.cms_total, r.cms_abnormal) for r in histogram.zero_rows(histogram.totals(hist, CFG), CFG, "cms_total", "cms_abnormal").collect()}
    assert got == {"R2": (3, 1), "R3": (1, 1), "R4": (1, 1)}


def test_empty_records(spark, sample):
    none = sample.limit(0).select("sensor_id", "region", "reading", "confidence")
    rows = windows.window_stats(none, CFG).collect()
    assert len(rows) == 3 and all(r.cms_total == 0 and r.ci_high == 0.0 and r.heavy_buckets == [] and r.ams_f2 == 0.0 for r in rows)


def test_count_min_bounds(spark):
    rows = spark.createDataFrame([("R2", b, 1 + b % 7) for b in range(300)], "region string, bucket long, f long")
    cfg = replace(CFG, cms_epsilon=0.05)
    std = {r.bucket: r.estimate for r in countmin.query(rows, countmin.cells(rows, cfg), cfg).collect()}
    con = {r.bucket: (r.f, r.estimate) for r in countmin.conservative(rows, cfg).collect()}
    assert all(f <= e <= std[b] for b, (f, e) in con.items()) and len(con) == 300
    assert countmin.geometry(CFG) == (2719, 5)


def test_ams_is_unbiased_over_seeds(spark):
    rows = spark.createDataFrame([("R2", b, 10) for b in range(40)], "region string, bucket long, f long")
    got = [ams.median_of_means(ams.accumulators(rows, replace(CFG, ams_seed=s)), CFG).first().ams_f2 for s in range(6)]
    assert sum(got) / len(got) == pytest.approx(4000, rel=0.15)


def test_ams_few_sketches_use_the_mean(spark):
    rows = spark.createDataFrame([("R2", 1, 3)], "region string, bucket long, f long")
    cfg = replace(CFG, ams_sketches=4)
    assert ams.median_of_means(ams.accumulators(rows, cfg), cfg).first().ams_f2 == 9.0


def test_reservoir_skips_weights(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, None), (3, -1.0), (4, 2.0), (5, 1e-300)], "seq long, score double")
    assert sorted(r.seq for r in sampling.reservoir(rows, 10).collect()) == [4, 5]


def test_zero_weights_bootstrap(spark):
    rows = spark.createDataFrame([("R2", 0.0, 200.0, 0.9)] * 3, "region string, score double, reading_hat double, confidence double")
    assert sampling.expectation(rows, CFG).first().p == 0.0


def test_positions_match_the_expression(spark):
    items = spark.createDataFrame([(f"R2-D{i}",) for i in range(50)], "sensor_id string")
    got = {(r.sensor_id, r.i): r.pos for r in bloom.positions(items, CFG).collect()}
    assert all(got[f"R2-D{i}", k] == p for i in range(50) for k, p in enumerate(bloom_positions(f"R2-D{i}", CFG)))


def test_stable_bloom():
    f = StableBloom(replace(CFG, bloom_decay=0))
    for i in range(100):
        f.add(f"d{i}")
    assert all(f"d{i}" in f for i in range(100)) and "x" not in f and 0 < f.saturation < 0.06
    f.decay(-3)
    before = f.cells.sum()
    f.decay(50)
    assert f.cells.sum() <= before
    with pytest.raises(ValueError):
        replace(CFG, bloom_cells=0)


@pytest.mark.parametrize("score, want", [(0.44, None), (0.45, "medium"), (0.60, "high"), (0.75, "critical"), (1.0, "critical")])
def test_severity(spark, score, want):
    assert spark.range(1).select(alerting.severity(F.lit(score), CFG)).first()[0] == want


def test_cooldown(spark):
    rows = spark.createDataFrame([("R2", t) for t in (0, 299, 300, 500, 600, 1200)] + [("R3", 100)], "region string, ts_seconds long")
    got = sorted((r.region, r.ts_seconds) for r in alerting.cooled(rows, CFG).collect())
    assert got == [("R2", 0), ("R2", 300), ("R2", 600), ("R2", 1200), ("R3", 100)]


def test_latest_row_wins(spark):
    rows = spark.createDataFrame([("R2", 1, 1.0), ("R2", 2, 3.0), ("R2", 9, 2.0)], "region string, v int, write_ts double")
    assert sensors.latest_per_region(rows).first().v == 2


def test_sensor_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sensor_id":"a","region":"R2","confidence":0.5}\n\n{"sensor_id":"b","region":"R3","reading":3.5,"confidence":1.0,"metadata":{"note":"x"}}\n')
    rows = {r.sensor_id: r for r in sensors.read_sensor_json(spark, str(tmp_path / "a.jsonl")).collect()}
    assert rows["a"].reading is None and rows["a"].metadata == {} and rows["b"].metadata == {"note": "x"}
    (tmp_path / "b.jsonl").write_text('{"sensor_id":"a","region":"R2"}\n')
    with pytest.raises(Exception, match="confidence"):
        sensors.read_sensor_json(spark, str(tmp_path / "b.jsonl")).collect()


def test_missing_stats(spark, tmp_path):
    assert sensors.read_reported_stats(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sensors.read_reported_stats(spark, str(tmp_path / "none"), missing_ok=False)


def test_sinks(spark, sample, tmp_path, capsys):
    cfg = replace(CFG, base_dir=str(tmp_path), sinks=({"type": "jsonl"}, {"type": "csv"}, {"type": "stdout"}, {"type": "webhook", "url_stats": "http://127.0.0.1:9/", "url_alerts": "http://127.0.0.1:9/", "timeout_sec": 0.2, "max_retries": 1}))
    made, run = sinks.build_sinks(cfg)
    stats = windows.stage_stats(sample.withColumn("seq", F.monotonically_increasing_id()), replace(cfg, bootstrap_replicates=20))
    raised = windows.alerts(stats, replace(cfg, severities=(("medium", 0.0),)), "w1")
    assert sinks.export(made, stats, "w1", raised) == []
    out = capsys.readouterr().out
    assert "stats: 3" in out and "webhook" in out
    back = spark.read.json(f"{run}/results/stats.jsonl")
    assert back.count() == 3 and {"window_id", "write_ts", "evidence_score"} <= set(back.columns)
    table = spark.read.option("header", True).csv(f"{run}/results/alerts.csv")
    assert table.columns == list(sinks.CSV_ALERTS)


def test_a_failing_sink_does_not_stop_the_others(spark, sample, tmp_path):
    class Broken:
        def write_stats(self, *a):
            raise OSError("disk")

        write_alerts = write_stats

    failed = sinks.export([Broken(), sinks.JsonSink(str(tmp_path))], sample, "w")
    assert len(failed) == 1 and (tmp_path / "stats.jsonl").exists()


def test_config():
    cfg = from_dict({"risk_multipliers": {"R2": 2, "default": 1.5}, "thresholds": {"anomaly_reading": 100}, "bucket_width": 10, "ams": {"num_sketches": 64}, "reporting": {"sinks": [{"type": "stdout"}]}})
    assert cfg.risk == {"R2": 2.0} and cfg.default_risk == 1.5 and cfg.anomaly_reading == 100 and cfg.max_bucket == 20 and cfg.ams_sketches == 64 and cfg.sinks == ({"type": "stdout"},)


def test_alert_settings():
    cfg = from_dict({"alerts": {"min_evidence_score": 0.5, "min_hll_estimate": 7, "min_sample_size_for_alert": 9, "cooldown_seconds": 60, "severity_thresholds": {"high": 0.7}}, "stable_bloom": {"counter_bits": 5}, "estimation": {"rng_seed": 3}})
    assert (cfg.min_evidence_score, cfg.min_hll_estimate, cfg.min_sample_size_for_alert, cfg.cooldown_seconds, cfg.bloom_max, cfg.bootstrap_seed) == (0.5, 7, 9, 60, 31, 3)
    assert cfg.severities == (("critical", 0.75), ("high", 0.7), ("medium", 0.45))


def test_sinks_send_every_row(spark, monkeypatch, capsys):
    rows = spark.range(25).selectExpr("concat('R', id) AS region", "id * 1.0 AS p_hat")
    sinks.StdoutSink().write_stats(rows, "w")
    assert len(capsys.readouterr().out.splitlines()) == 26
    sent = []
    monkeypatch.setattr(sinks.WebhookSink, "POST_ROWS", 10)
    monkeypatch.setattr(sinks.WebhookSink, "_send", lambda self, url, body: sent.append(__import__("json").loads(body)) or True)
    sinks.WebhookSink("u", "v").write_stats(rows, "w")
    assert [len(x["items"]) for x in sent] == [10, 10, 5] and sent[0]["items"][0] == {"region": "R0", "p_hat": 0.0}


def test_relative_errors_of_nothing(spark, sample):
    """Where the exact value is 0 the relative error is 0, whatever was reported."""
    records = sample.select("sensor_id", "region", "reading", "confidence")
    reported = windows.window_stats(records, CFG).withColumn("hll_estimate", F.lit(5).cast("long"))
    out = windows.compare(records.where("confidence < 0.5"), reported, CFG)
    assert all(r.hll_rel_err == 0.0 and r.hll_ok for r in out.collect())
    row = windows.nested(out).first().asDict(recursive=True)
    assert list(row) == ["region", "ref", "reported", "diffs", "status"] and "hll_estimate(ref_global)" in row["ref"] and row["reported"]["heavy_buckets"] is not None


def test_synthetic_shares(spark):
    rows = sensors.synthetic(spark, CFG).toPandas()
    assert len(rows) == 950 and rows["reading"].isna().sum() == pytest.approx(950 * 0.04, abs=25)
    assert rows["reading"].max() <= 290 and rows["confidence"].between(0.05, 0.97).all()
    assert math.isclose((rows["note"].str.startswith("forced")).mean(), 0.10, abs_tol=0.04)


def test_run_and_compare(spark, tmp_path):
    from driftwell.__main__ import compare_run, main, run

    cfg = replace(CFG, base_dir=str(tmp_path))
    run_dir = run(spark, cfg)
    report = compare_run(spark, run_dir, cfg).collect()
    assert [r.region for r in report] == ["R2", "R3", "R4"] and all(r.p_hat_ok and r.ci_ok and r.hll_ok for r in report)
    written = spark.read.json(f"{run_dir}/results/compare.jsonl")
    assert written.count() == 3 and set(written.columns) == {"region", "ref", "reported", "diffs", "status"}
    with pytest.raises(SystemExit):
        main(["compare"])

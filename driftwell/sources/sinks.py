"""Sinks for window statistics and alerts. Each takes (DataFrame, window_id); one that fails is reported, the others go on."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from datetime import UTC, datetime
from itertools import islice
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

#: The columns that rows are written with, in order.
STATS_COLUMNS = ("region", "p_hat", "ci_low", "ci_high", "heavy_bucket_ratio", "heavy_buckets", "cms_total", "cms_abnormal", "hll_estimate", "ams_f2", "sample_size", "sbf_saturation", "evidence_score")
ALERT_COLUMNS = ("region", "window_id", "severity", "score", "reason", "metrics", "thresholds", "timestamp")
CSV_STATS = ("window_id", "region", "p_hat", "ci_low", "ci_high", "sample_size", "cms_total", "cms_abnormal", "heavy_bucket_ratio", "hll_estimate", "sbf_saturation", "evidence_score", "heavy_buckets", "ams_f2")
CSV_ALERTS = ("window_id", "region", "severity", "score", "reason", "p_hat", "ci_low", "ci_high", "cms_total", "cms_abnormal", "heavy_bucket_ratio", "hll_estimate", "sbf_saturation", "timestamp")


class Sink(Protocol):
    def write_stats(self, stats: DataFrame, window_id: str) -> None: ...

    def write_alerts(self, alerts: DataFrame, window_id: str) -> None: ...


def _stamped(df: DataFrame, known: tuple[str, ...], window_id: str) -> DataFrame:
    return df.select(*[c for c in known if c in df.columns]).withColumns({"window_id": F.lit(window_id), "write_ts": F.lit(time.time())})


def _listed(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))


class JsonSink:
    """Appends rows as JSON lines to directories stats.jsonl and alerts.jsonl."""

    def __init__(self, base: str):
        self.base = base

    def _append(self, df: DataFrame, known: tuple[str, ...], window_id: str, name: str) -> None:
        _stamped(df, known, window_id).write.mode("append").option("ignoreNullFields", "false").json(f"{self.base}/{name}")

    def write_stats(self, stats: DataFrame, window_id: str) -> None:
        self._append(stats, STATS_COLUMNS, window_id, "stats.jsonl")

    def write_alerts(self, alerts: DataFrame, window_id: str) -> None:
        self._append(alerts, ALERT_COLUMNS, window_id, "alerts.jsonl")


class CsvSink:
    """Appends rows with fixed columns; what is missing is empty, lists are written in brackets."""

    def __init__(self, base: str):
        self.base = base

    def _append(self, df: DataFrame, columns: tuple[str, ...], window_id: str, name: str) -> None:
        df = df.withColumn("window_id", F.lit(window_id))
        if "metrics" in df.columns:
            df = df.select("*", *[F.col(f"metrics.{c}") for c in df.schema["metrics"].dataType.names if c in columns and c not in df.columns])
        kinds = dict(df.dtypes)
        cell = lambda c: F.lit("") if c not in kinds else _listed(F.col(c)) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
        df.select(*[cell(c).alias(c) for c in columns]).write.mode("append").option("header", True).option("emptyValue", "").csv(f"{self.base}/{name}")

    def write_stats(self, stats: DataFrame, window_id: str) -> None:
        self._append(stats, CSV_STATS, window_id, "stats.csv")

    def write_alerts(self, alerts: DataFrame, window_id: str) -> None:
        self._append(alerts, CSV_ALERTS, window_id, "alerts.csv")


class StdoutSink:
    """Prints the number of rows and one JSON document for each, partition by partition."""

    def _print(self, df: DataFrame, window_id: str, what: str) -> None:
        print(f"[{window_id}] {what}: {df.count()}")
        for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).toLocalIterator():
            print(row.row)

    def write_stats(self, stats: DataFrame, window_id: str) -> None:
        self._print(_stamped(stats, STATS_COLUMNS, window_id), window_id, "stats")

    def write_alerts(self, alerts: DataFrame, window_id: str) -> None:
        self._print(_stamped(alerts, ALERT_COLUMNS, window_id), window_id, "alerts")


class WebhookSink:
    """Posts {window_id, items} in chunks of at most POST_ROWS items, so that any number of rows is sent whole; network
    errors are tried again, a final failure is printed."""

    POST_ROWS = 1000

    def __init__(self, url_stats: str, url_alerts: str, timeout: float = 5.0, retries: int = 2, pause: float = 0.3):
        self.url_stats, self.url_alerts = url_stats, url_alerts
        self.timeout, self.retries, self.pause = timeout, retries, pause

    def _post(self, url: str, df: DataFrame, window_id: str) -> bool:
        rows = (json.loads(r.row) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).toLocalIterator())
        sent, done = 0, True
        while (items := list(islice(rows, self.POST_ROWS))) or not sent:
            sent += 1
            done = self._send(url, json.dumps({"window_id": window_id, "items": items}, ensure_ascii=False).encode()) and done
        return done

    def _send(self, url: str, body: bytes) -> bool:
        error: Exception | None = None
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout):
                    return True
            except (urllib.error.HTTPError, urllib.error.URLError) as e:
                error = e
                if attempt < self.retries:
                    time.sleep(self.pause)
        print(f"webhook {url} failed: {error}")
        return False

    def write_stats(self, stats: DataFrame, window_id: str) -> None:
        self._post(self.url_stats, stats.select(*[c for c in STATS_COLUMNS if c in stats.columns]), window_id)

    def write_alerts(self, alerts: DataFrame, window_id: str) -> None:
        self._post(self.url_alerts, alerts.select(*[c for c in ALERT_COLUMNS if c in alerts.columns]), window_id)


def build_sinks(cfg: Config, now: datetime | None = None) -> tuple[list[Sink], str]:
    """(the configured sinks, the run's directory): results go below <base>/<UTC time>/results."""
    run = f"{cfg.base_dir}/{(now or datetime.now(UTC)):%Y%m%d-%H%M}"
    results = f"{run}/results"
    made: list[Sink] = []
    for spec in cfg.sinks:
        match spec.get("type"):
            case "jsonl":
                made.append(JsonSink(results))
            case "csv":
                made.append(CsvSink(results))
            case "stdout":
                made.append(StdoutSink())
            case "webhook":
                made.append(WebhookSink(spec["url_stats"], spec["url_alerts"], float(spec.get("timeout_sec", 5)), int(spec.get("max_retries", 2))))
            case other:
                raise ValueError(f"unknown sink: {other}")
    return made, run


def export(sinks: list[Sink], stats: DataFrame, window_id: str, alerts: DataFrame | None = None) -> list[str]:
    """Writes to every sink; returns what failed."""
    failed = []
    for sink in sinks:
        for write, df in ((sink.write_stats, stats), (sink.write_alerts, alerts)):
            if df is not None:
                try:
                    write(df, window_id)
                except Exception as e:  # noqa: BLE001  a failing sink must not stop the others
                    failed.append(f"{type(sink).__name__}: {e}")
                    print(f"sink failed: {failed[-1]}")
    return failed

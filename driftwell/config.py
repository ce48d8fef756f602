"""Settings of all operators, from defaults or a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Config:
    """Defaults are fixed values: they decide the numbers that the operators return."""

    regions: tuple[str, ...] = ("R2", "R3", "R4")
    risk: dict[str, float] = field(default_factory=lambda: {"R2": 1.2, "R3": 1.3, "R4": 1.0})
    default_risk: float = 1.0
    fallback: dict[str, float] = field(default_factory=lambda: {"R3": 151.0, "R2": 95.0})
    default_fallback: float = 50.0
    anomaly_reading: float = 145.0
    min_confidence: float = 0.60
    suspect_confidence: float = 0.50
    bucket_width: float = 5.0
    max_bucket: int = 40
    heavy_ratio: float = 0.05
    alpha: float = 0.05
    cms_epsilon: float = 0.001
    cms_delta: float = 0.01
    ams_sketches: int = 256
    ams_seed: int = 2026
    ams_groups: int = 8
    reservoir_size: int = 50_000
    lsh_tables: int = 5
    lsh_bits: int = 16
    lsh_seed: int = 42
    bloom_cells: int = 8192
    bloom_hashes: int = 4
    bloom_max: int = 15
    bloom_decay: int = 2
    bloom_seed: int = 1337
    bootstrap_replicates: int = 500
    bootstrap_min_n: int = 30
    bootstrap_seed: int = 2024
    min_ci_lower: float = 0.05
    min_p_hat: float = 0.08
    min_evidence_score: float = 0.45
    min_heavy_buckets: int = 1
    min_hll_estimate: int = 5
    min_cms_total: int = 200
    min_sample_size_for_alert: int = 30
    severities: tuple[tuple[str, float], ...] = (("critical", 0.75), ("high", 0.60), ("medium", 0.45))
    cooldown_seconds: int = 300
    strict_gates: bool = False
    sinks: tuple[dict[str, Any], ...] = ({"type": "jsonl"}, {"type": "csv"})
    base_dir: str = "out"

    def __post_init__(self) -> None:
        if not 0 < self.bloom_cells or not 0 < self.bloom_hashes or not 0 < self.bloom_max or self.bloom_decay < 0:
            raise ValueError("bloom filter settings must be positive, and decay not negative")


def load_config(path: str) -> Config:
    """A Config from a YAML file; keys that are absent keep their defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})


def from_dict(raw: dict[str, Any]) -> Config:
    out: dict[str, Any] = {}

    def take(section: str, key: str, name: str, kind: Any = float) -> None:
        value = (raw.get(section) or {}).get(key)
        if value is not None:
            out[name] = kind(value)

    if raw.get("risk_multipliers"):
        risk = {str(k): float(v) for k, v in raw["risk_multipliers"].items()}
        out["default_risk"] = risk.pop("default", 1.0)
        out["risk"] = risk
    if raw.get("regions"):
        out["regions"] = tuple(raw["regions"])
    if raw.get("bucket_width"):
        out["bucket_width"] = float(raw["bucket_width"])
        out["max_bucket"] = int(200 // max(1, out["bucket_width"]))
    take("thresholds", "anomaly_reading", "anomaly_reading")
    take("thresholds", "min_confidence_for_hll", "min_confidence")
    take("count_min", "epsilon", "cms_epsilon")
    take("count_min", "delta", "cms_delta")
    take("count_min", "max_bucket", "max_bucket", int)
    take("ams", "num_sketches", "ams_sketches", int)
    take("ams", "seed", "ams_seed", int)
    take("reservoir", "size", "reservoir_size", int)
    take("lsh", "num_tables", "lsh_tables", int)
    take("lsh", "num_bits", "lsh_bits", int)
    take("lsh", "seed", "lsh_seed", int)
    for key, name in (("num_cells", "bloom_cells"), ("num_hashes", "bloom_hashes"), ("decay_per_insert", "bloom_decay"), ("seed", "bloom_seed")):
        take("stable_bloom", key, name, int)
    take("estimation", "alpha", "alpha")
    take("estimation", "heavy_ratio_threshold", "heavy_ratio")
    take("estimation", "n_bootstrap", "bootstrap_replicates", int)
    take("estimation", "min_samples_for_bootstrap", "bootstrap_min_n", int)
    take("estimation", "rng_seed", "bootstrap_seed", int)
    bits = (raw.get("stable_bloom") or {}).get("counter_bits")
    if bits is not None:
        out["bloom_max"] = (1 << int(bits)) - 1
    for key in ("min_cms_total", "min_sample_size_for_alert", "min_heavy_buckets", "min_hll_estimate", "cooldown_seconds"):
        take("alerts", key, key, int)
    for key in ("min_ci_lower", "min_p_hat", "min_evidence_score"):
        take("alerts", key, key)
    given = (raw.get("alerts") or {}).get("severity_thresholds")
    if given is not None:
        out["severities"] = tuple((name, float(given.get(name, least))) for name, least in Config().severities)
    if (raw.get("reporting") or {}).get("sinks"):
        out["sinks"] = tuple(raw["reporting"]["sinks"])
    if (raw.get("output") or {}).get("base_dir"):
        out["base_dir"] = str(raw["output"]["base_dir"])
    return Config(**out)

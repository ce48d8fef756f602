"""Keyed state on streams: the stable Bloom filter and the alert cooldown.

A single filter for all devices is one key and one task; sharded by region (or any key) it
scales, at the price of one filter for each shard. Timing comes from the rows, so replays agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config


def bloom_positions(item: str, cfg: Config) -> list[int]:
    """(h1 + i h2) modulo cells, from the first two big-endian words of SHA-256 over seed, "/" and item."""
    h = hashlib.sha256(cfg.bloom_seed.to_bytes(8, "little") + b"/" + item.encode()).digest()
    h1, h2 = int.from_bytes(h[:8], "big"), int.from_bytes(h[8:16], "big") or 0x9E3779B97F4A7C15
    return [(h1 + i * h2) % cfg.bloom_cells for i in range(cfg.bloom_hashes)]


class StableBloom:
    """Counters that inserts raise to the maximum and that random decay lowers."""

    def __init__(self, cfg: Config, cells: bytes | None = None, inserts: int = 0):
        self.cfg, self.inserts = cfg, inserts
        self.cells = np.frombuffer(cells, dtype=np.uint8).copy() if cells else np.zeros(cfg.bloom_cells, dtype=np.uint8)

    def add(self, item: str) -> None:
        self.decay(self.cfg.bloom_decay)
        self.inserts += 1
        self.cells[bloom_positions(item, self.cfg)] = self.cfg.bloom_max

    def decay(self, steps: int) -> None:
        """steps cells, chosen by a hash of the number of inserts, lose one; a negative number counts as none."""
        for j in range(max(0, steps)):
            h = hashlib.sha256(f"{self.cfg.bloom_seed}:{self.inserts}:{j}".encode()).digest()
            at = int.from_bytes(h[:8], "big") % self.cfg.bloom_cells
            self.cells[at] -= self.cells[at] > 0

    def __contains__(self, item: str) -> bool:
        return bool((self.cells[bloom_positions(item, self.cfg)] > 0).all())

    @property
    def saturation(self) -> float:
        return float((self.cells > 0).mean())

    def stats(self) -> dict[str, Any]:
        c = self.cfg
        return {"cells": c.bloom_cells, "hashes": c.bloom_hashes, "max": c.bloom_max, "decay": c.bloom_decay, "saturation": self.saturation}


def suspects_seen(suspects: DataFrame, cfg: Config, key: str = "region") -> DataFrame:
    """For each suspect row (key, seq, sensor_id): whether its shard's filter held the device before it, and the saturation after."""

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cells, inserts = state.get if state.exists else (None, 0)
        bloom = StableBloom(cfg, cells, inserts)
        rows = pd.concat(list(batches)).sort_values("seq")
        seen, full = [], []
        for item in rows["sensor_id"]:
            seen.append(item in bloom)
            bloom.add(item)
            full.append(bloom.saturation)
        state.update((bloom.cells.tobytes(), bloom.inserts))
        yield pd.DataFrame({key: rows[key], "seq": rows["seq"], "sensor_id": rows["sensor_id"], "seen": seen, "saturation": full})

    schema = f"{key} string, seq long, sensor_id string, seen boolean, saturation double"
    return suspects.select(key, "seq", "sensor_id").groupBy(key).applyInPandasWithState(step, schema, "cells binary, inserts long", "append", GroupStateTimeout.NoTimeout)


def cooldown(alerts: DataFrame, cfg: Config) -> DataFrame:
    """Alerts (region, ts_seconds) that come at least cooldown_seconds after the last one emitted for their region."""

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts_seconds")
        kept = []
        for t in rows["ts_seconds"]:
            if last is None or t - last >= cfg.cooldown_seconds:
                last = float(t)
                kept.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"region": [group[0]] * len(kept), "ts_seconds": kept})

    return alerts.select("region", "ts_seconds").groupBy("region").applyInPandasWithState(step, "region string, ts_seconds double", "last double", "append", GroupStateTimeout.NoTimeout)

"""Positions and membership of the (stable) Bloom filter; its decaying state is in streaming.bloom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def hash_pair(item: Column, cfg: Config) -> tuple[Column, Column]:
    """Two numbers from SHA-256 of (seed as 8 little-endian bytes, "/", item), modulo a power of two of cells."""
    if cfg.bloom_cells & (cfg.bloom_cells - 1) or cfg.bloom_cells > 1 << 16:
        raise ValueError("a power of two of cells, up to 65536, is needed here")
    salt = cfg.bloom_seed.to_bytes(8, "little").hex()
    h = F.sha2(F.concat(F.unhex(F.lit(salt)), F.encode(F.concat(F.lit("/"), item), "utf-8")), 256)
    low = lambda at: F.conv(F.substring(h, at, 4), 16, 10).cast("long") % cfg.bloom_cells
    return low(13), low(29)


def positions(items: DataFrame, cfg: Config, item: str = "sensor_id") -> DataFrame:
    """items with one row for each hash function: i, pos."""
    h1, h2 = hash_pair(F.col(item), cfg)
    rows = items.withColumns({"h1": h1, "h2": h2}).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cfg.bloom_hashes - 1))))
    return rows.withColumn("pos", (F.col("h1") + F.col("i") * F.col("h2")) % cfg.bloom_cells).drop("h1", "h2")


def cells(items: DataFrame, cfg: Config) -> DataFrame:
    """(pos): the cells set by items, without decay. At most bloom_cells rows."""
    return positions(items.select("sensor_id").distinct(), cfg).select("pos").distinct()


def saturation(items: DataFrame, cfg: Config) -> DataFrame:
    """One row: the share of cells that are set."""
    return cells(items, cfg).agg((F.count("*") / F.lit(float(cfg.bloom_cells))).alias("sbf_saturation"))


def maybe_members(probes: DataFrame, items: DataFrame, cfg: Config) -> DataFrame:
    """(sensor_id): distinct probes all of whose cells are set. The cells are bounded by the filter's size."""
    hits = positions(probes.select("sensor_id").distinct(), cfg).join(F.broadcast(cells(items, cfg)), "pos", "left_semi")
    return hits.groupBy("sensor_id").agg(F.count("*").alias("n")).where(F.col("n") == cfg.bloom_hashes).select("sensor_id")

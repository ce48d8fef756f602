"""Random-hyperplane signatures, candidates and bucket statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..config import Config
from ..functions.hashing import gaussian_value

def planes(cfg: Config, dim: int) -> list[list[list[float]]]:
    """Normal vectors by table and bit: as many numbers as tables, bits and dimensions."""
    return [[[gaussian_value(cfg.lsh_seed, t, b, d) for d in range(dim)] for b in range(cfg.lsh_bits)] for t in range(cfg.lsh_tables)]


def signature_of(cfg: Config, dim: int):
    """An Arrow function of vectors to their signatures, one for each table: a matrix product for each batch. One bit for
    each plane, 1 where the product is not negative; a null component makes all bits 0."""
    normals = np.array(planes(cfg, dim)).reshape(-1, dim).T

    @F.arrow_udf(ArrayType(StringType()))
    def signature(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        letters = np.where(x @ normals >= 0, b"1", b"0").astype("S1")
        names = np.ascontiguousarray(letters).view(f"S{cfg.lsh_bits}").ravel()
        offsets = np.arange(0, len(names) + 1, cfg.lsh_tables, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(names.astype(f"U{cfg.lsh_bits}"), pa.string()))

    return signature


def signatures(items: DataFrame, cfg: Config, dim: int, vector: str = "features") -> DataFrame:
    """items with one row for each table: table_idx, signature; rows of another dimension are dropped."""
    signed = items.where(F.size(vector) == dim).withColumn("_s", signature_of(cfg, dim)(F.col(vector)))
    return signed.select(*items.columns, F.posexplode("_s").alias("table_idx", "signature"))


def candidates(signed: DataFrame, probes: DataFrame, most: int) -> DataFrame:
    """(probe, seq, place): items that share a bucket with a probe, in order of table, then insertion, the first most.

    A bucket's first `most` items suffice: of these at most as many were taken from tables before as places are filled.
    """
    first = F.row_number().over(W.partitionBy("table_idx", "signature").orderBy("seq"))
    heads = signed.select("table_idx", "signature", "seq").withColumn("n", first).where(F.col("n") <= most).drop("n")
    met = probes.select(F.col("seq").alias("probe"), "table_idx", "signature").join(heads, ["table_idx", "signature"])
    per = met.groupBy("probe", "seq").agg(F.min("table_idx").alias("t"))
    place = F.row_number().over(W.partitionBy("probe").orderBy("t", "seq"))
    return per.withColumn("place", place).where(F.col("place") <= most).select("probe", "seq", "place")


def bucket_stats(signed: DataFrame, dim: int, min_size: int, top_k: int, vector: str = "features") -> DataFrame:
    """(table_idx, signature, size, means, example_ids): the largest buckets; ties by table, then first insertion."""
    means = F.array(*[F.avg(F.get(vector, F.lit(d))) for d in range(dim)])
    per = signed.groupBy("table_idx", "signature").agg(F.count("*").alias("size"), means.alias("means"), F.array(F.min_by("sensor_id", "seq")).alias("example_ids"), F.min("seq").alias("first"))
    return per.where(F.col("size") >= min_size).orderBy(F.desc("size"), "table_idx", "first").limit(top_k)

"""Reproducible randomness: uniforms, signs and positions derived from hashes, equal on every engine."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(1 << 52)


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts as text, joined by bars."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def bits52(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A uniform in [0, 1)."""
    return bits52(digest(*parts)) / F.lit(TWO_52)


def open_uniform(*parts: Column | str | int) -> Column:
    """A uniform in (0, 1), safe under a logarithm."""
    return (bits52(digest(*parts)) + F.lit(0.5)) / F.lit(TWO_52)


def gaussian(*parts: Column | str | int) -> Column:
    """A standard normal by Box-Muller."""
    return F.sqrt(F.lit(-2.0) * F.ln(open_uniform(*parts, "a"))) * F.cos(F.lit(2.0 * math.pi) * open_uniform(*parts, "b"))


def sign(*parts: Column | str | int) -> Column:
    """+1 or -1 by the lowest bit of the digest's last digit (even: +1)."""
    return F.lit(1) - F.lit(2) * (F.conv(F.substring(digest(*parts), 32, 1), 16, 10).cast("int") % 2)


def uniform_value(*parts: object) -> float:
    """open_uniform() on the driver, for small tables of literals."""
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / TWO_52


def gaussian_value(*parts: object) -> float:
    return math.sqrt(-2.0 * math.log(uniform_value(*parts, "a"))) * math.cos(2.0 * math.pi * uniform_value(*parts, "b"))

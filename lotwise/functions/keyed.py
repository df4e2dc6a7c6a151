"""Randomness as a function of a key.

A draw depends only on its key, so a task that is retried, or a table that is re-partitioned,
sees the same numbers.  Use a secret seed for a private run.
"""

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 12
SPAN = float(16**HEX_DIGITS)


def key_of(*parts):
    """Text key ``a|b|c``; plain values become literals, names stay columns only as ``Column``."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in columns])


def keyed_hex(*parts):
    return F.md5(key_of(*parts).cast("binary"))


def keyed_uniform(*parts):
    """Uniform on the open interval (0, 1)."""
    digits = F.substring(keyed_hex(*parts), 1, HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(SPAN)


def keyed_normal(*parts):
    """Standard normal by the Box-Muller transform of two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(keyed_uniform(*parts, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * keyed_uniform(*parts, "t"))


def _uniform(key):
    digits = hashlib.md5(key.encode()).hexdigest()[:HEX_DIGITS]
    return (int(digits, 16) + 0.5) / SPAN


def normal_vector(width, *parts):
    """What ``keyed_normal(*parts, i)`` draws for i = 0 .. width - 1, inside a task."""
    key = "|".join(map(str, parts))
    radius = [math.sqrt(-2.0 * math.log(_uniform(f"{key}|{i}|r"))) for i in range(width)]
    angle = [2.0 * math.pi * _uniform(f"{key}|{i}|t") for i in range(width)]
    return np.array(radius) * np.cos(angle)

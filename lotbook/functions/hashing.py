"""Repeatable randomness: everything follows from the md5 digest of a unique key and a seed.

Unlike ``rand(seed)`` the digest does not depend on how rows are spread over partitions, so a
sample or a split stays the same after a repartition, on a bigger cluster, or in a retried task.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 32


def digest(key: str | Column, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def share_limit(share: float | Fraction) -> str:
    """The digest below which a ``share`` of all digests lies."""
    limit = math.floor((share if isinstance(share, Fraction) else Fraction(str(share))) * 16**DIGITS)
    return "g" if limit >= 16**DIGITS else f"{limit:0{DIGITS}x}"


def uniform(hex_digest: Column, start: int) -> Column:
    """A number strictly between 0 and 1 from the eight hex digits at ``start`` (1-based)."""
    whole = F.conv(F.substring(hex_digest, start, 8), 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(16**8))


def standard_normal(hex_digest: Column) -> Column:
    """A standard normal draw made from two parts of the digest (Box and Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(hex_digest, 1)))
    return radius * F.cos(F.lit(2.0) * F.pi() * uniform(hex_digest, 9))

"""Seeded, engine-independent row ordering.

Orders and draws are derived from ``md5('<seed>:<key>')`` so the same rows
come out whatever the partitioning, the number of executors, or the engine
(the SQL oracle computes the identical hex string).  Never
``monotonically_increasing_id`` or partition order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *cols) -> Column:
    """32-char hex md5 of ``'seed:c1:c2...'``; lexical order = a seeded shuffle."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws(":", *parts))


#: Hex digits of a draw: 60 bits, the most that fit a BIGINT.
DRAW_DIGITS = 15


def hash_int(h: Column, digits: int = DRAW_DIGITS) -> Column:
    """First ``digits`` hex digits of a hash as a non-negative BIGINT."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def hash_bucket(h: Column, digits: int) -> Column:
    """Order-preserving bucket of a hex hash: its first ``digits`` characters."""
    return F.substring(h, 1, digits)

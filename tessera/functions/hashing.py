"""Deterministic, partition-independent random draws from row keys.

A draw is a function of (key, salt..., seed) only, so results do not depend
on row order, partitioning or executor retries, and DuckDB reproduces them:

    Spark:  cast(conv(substr(md5(s),1,8),16,10) as double) / 4294967296
    DuckDB: ('0x' || substr(md5(s),1,8))::BIGINT / 4294967296.0
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed: 2^32, the range of an 8-hex-digit md5 prefix
TWO_POW_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_text(key, *salts) -> Column:
    """md5 hex of 'key|salt1|salt2|...' (all parts rendered as strings)."""
    parts = [_as_col(key).cast("string")] + [
        (_as_col(s).cast("string") if isinstance(s, Column) else F.lit(str(s))) for s in salts
    ]
    return F.md5(F.concat_ws("|", *parts))


def unit_draw(key, *salts) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of the md5."""
    return F.conv(F.substring(hash_text(key, *salts), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def hash_bucket(hex_text: Column, hex_digits: int) -> Column:
    """Order-preserving bucket of an md5 hex: its first ``hex_digits`` digits."""
    return F.substring(hex_text, 1, hex_digits)

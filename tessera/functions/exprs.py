"""Small column-expression helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOATING = ("double", "float")


def as_missing(c: Column, dtype: str, to_null: bool = False) -> Column:
    """NaN and null are one 'missing' value (pandas semantics).

    to_null=False: boolean 'is missing'. to_null=True: the value with NaN
    turned into null.
    """
    floating = dtype in _FLOATING
    if to_null:
        return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c) if floating else c
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or ``default`` when den is 0 (the reference's guarded rates)."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(default))


def map_lookup(mapping: dict, key: Column, value_type: str = "int") -> Column:
    """JVM-side literal map lookup: a narrow projection, no join."""
    if not mapping:
        return F.lit(None).cast(value_type)
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v).cast(value_type)]
    return F.create_map(*kv)[key]

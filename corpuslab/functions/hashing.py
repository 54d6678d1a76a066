"""Deterministic hashing shared with the SQL oracle.

``h32(s)`` is the first 8 hex digits of ``md5(s)`` read as an unsigned
integer; DuckDB spells the same value ``('0x'||substr(md5(s),1,8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    return F.lit(str(c))


def h32(*parts) -> Column:
    s = F.concat(*[_as_str(p) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def unit_uniform(*parts) -> Column:
    """Uniform in [0, 1): h32 / 2^32 (exact in double)."""
    return h32(*parts) / F.lit(4294967296.0)


def h32_sql(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"

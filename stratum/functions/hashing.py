"""Seeded, engine-independent pseudo-randomness.

A draw is ``md5(key | seed | draw)``; its first 8 hex digits read as an
unsigned 32-bit integer divided by 2**32 give a uniform in [0, 1).  The same
expression is writable in DuckDB, so randomised operators stay checkable
value by value, and a draw depends only on the row's key (stable when
executors are lost and tasks re-run).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def hash_uniform(key, seed, draw=0) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    d = draw if isinstance(draw, Column) else F.lit(str(draw))
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    h = F.md5(F.concat_ws("|", k.cast("string"), s.cast("string"), d.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO32)


def hash_uniform_sql(key_sql: str, seed, draw="0") -> str:
    d = draw if not isinstance(draw, int) else str(draw)
    return (f"(('0x' || substr(md5(concat_ws('|', CAST({key_sql} AS VARCHAR), '{seed}', "
            f"CAST({d} AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0)")

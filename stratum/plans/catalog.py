"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where the result is deterministic, the equivalent DuckDB SQL.

Doubles are rounded in both engines (``ROUND`` digits) so that different
summation orders cannot change the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.sources.bindings import with_sql

ROUND = 6

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Round every double/float column (plan-time projection)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def round_sql(body: str, cols: list[str], digits: int = ROUND) -> str:
    if not cols:
        return body
    rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) AS _r"


def register(name: str, sql: str | None = None, uses: tuple[str, ...] = (), dbl: tuple[str, ...] = (),
             digits: int = ROUND, raw: bool = False, ctes: str = ""):
    """Decorator: register a Spark query; ``sql`` is the oracle body reading the
    binding CTEs in ``uses``; ``dbl`` lists the double columns to round."""

    def deco(fn):
        def run(spark, sf_dir, _fn=fn):
            df = _fn(spark, sf_dir)
            return df if raw else rounded(df, digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = round_sql(with_sql(sql, *uses, extra=ctes) if (uses or ctes) else sql, list(dbl), digits)
        return fn

    return deco


def load_all():
    """Import every query module (registration happens at import)."""
    from stratum.plans import (  # noqa: F401
        q_profile, q_clean, q_features, q_stats, q_sampling, q_models, q_metrics, q_scoring,
    )
    return QUERIES, ORACLE

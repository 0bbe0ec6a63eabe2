"""Small expression helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b with NULL on a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clean_double(c) -> Column:
    """Cast to double and map NaN / ±inf to NULL (pandas treats them as missing)."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(None).cast("double")).otherwise(x)


def r(c, digits: int = 6) -> Column:
    """Round a double for cross-engine comparison."""
    return F.round(col(c).cast("double"), digits)


def numeric_columns(df, exclude=()) -> list[str]:
    """Plan-time role split: numeric columns by schema (no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns(df, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def stack(pairs: list[tuple[str, Column]], name_col: str = "column", value_col: str = "value") -> Column:
    """array<struct<name,value>> for unpivoting a wide one-row aggregate; use with F.inline."""
    return F.array(*[F.struct(F.lit(n).alias(name_col), v.alias(value_col)) for n, v in pairs])


def merge_one_row(*frames):
    """Combine one-row result frames side by side without a join: each row is
    fetched (bounded: one row) and a single row is rebuilt with the union of
    the schemas."""
    from pyspark.sql.types import StructType

    spark = frames[0].sparkSession
    fields, values = [], []
    for f in frames:
        r = f.first()
        fields += list(f.schema.fields)
        values += list(r) if r is not None else [None] * len(f.schema.fields)
    return spark.createDataFrame([tuple(values)], StructType(fields))

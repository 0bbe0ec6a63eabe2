"""Sources and sinks: CSV/parquet scans, column-name normalisation, table
sinks and fitted-model storage."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens pandas' CSV reader treats as missing by default.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of one test table; the projection reaches the scan (ReadSchema)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def normalize_name(name: str) -> str:
    return re.sub(" ", "_", name.strip())


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip column names and replace spaces with underscores (one projection)."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             null_tokens: list[str] | None = None) -> DataFrame:
    """Header CSV scan with pandas-like missing-value tokens.

    Everything is read as string (one splittable scan), then each column is
    trimmed, missing tokens become NULL and typed columns are ``try_cast``
    (a bad value becomes NULL instead of failing the job under ANSI mode).
    Column names are normalised.
    """
    toks = NULL_TOKENS if null_tokens is None else null_tokens
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    raw = normalize_columns(raw)
    target = {normalize_name(f.name): f.dataType for f in schema.fields} if schema else {}
    out = []
    for c in raw.columns:
        v = F.when(F.trim(F.col(c)).isin(toks) | F.col(c).isNull(), F.lit(None).cast("string")).otherwise(F.col(c))
        dt = target.get(c)
        if dt is not None and not isinstance(dt, T.StringType):
            v = v.try_cast(dt)
        out.append(v.alias(c))
    return raw.select(*out)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None, null_token: str = "") -> str:
    """Write a result table (parquet by default, CSV with header otherwise)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("nullValue", null_token).option("emptyValue", "").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def model_store(model, path: str) -> str:
    """Persist a fitted Spark ML model / PipelineModel (overwrites)."""
    model.write().overwrite().save(path)
    return path


def model_load(path: str):
    """Reload a persisted PipelineModel; a missing path raises (no silent untrained model)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)

"""The driver contract on the smallest scale factor: entry() runs, every
registered query has a callable, and a sample of oracles agree with DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SAMPLE = ["filtered_group_means", "describe", "welch_ttest_features", "anova_oneway", "smote", "tomek_links",
          "roc_auc", "pr_auc", "bootstrap_ci", "viterbi_decode", "score_answers", "adaptive_encode", "clip_iqr",
          "kde_grid", "split_stratified", "clean_data", "significance_report", "vote_soft_scores",
          "viterbi_scores_long", "box_stats", "confusion_matrix", "classification_report", "scan_csv", "train_select_rule", "model_store_roundtrip"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 64 and "p_value" in df.columns


def test_registry_complete():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    s = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=str)
    idx = [rel.columns.index(c) for c in order]
    d = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=str)
    assert s == d

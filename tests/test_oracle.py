"""Every query that has SQL gives DuckDB's rows."""

import pytest

from wellframe.plans import queries

from .compare import both

RUN, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    columns, names, got, want = both(spark, name, RUN[name], SQL[name])
    assert columns == names
    assert len(got) == len(want)
    assert got == want


#: Queries without SQL whose results other tests hold against plain versions, or which run for minutes.
ELSEWHERE = {"agglomerative_single", "agglomerative_ward", "corr_wide_summary", "balanced_batches", "cluster_bootstrap", "rf_cv", "tree_importance", "scenario_summary", "consensus_pairs", "dbscan", "anchor_permutation", "pca_scores", "kmeans", "loo_centroid_all", *(f"pairwise_{m}_all" for m in ("cosine", "euclidean", "correlation", "cityblock"))}


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL) - ELSEWHERE))
def test_runs(spark, name):
    df = RUN[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    for c in df.columns:
        if c.endswith(("p_value", "q_value")):
            assert all(r[c] is None or 0 <= r[c] <= 1 for r in rows)

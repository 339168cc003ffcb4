"""Queries on scores against classes by blocks, calibrated probabilities, Krylov components and named key columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellframe.operators import calibration, moa, projection
from wellframe.sources import tables

from .queries import query, r, rounded, table
from .queries_analysis import VECTORS, _flat, centres, vectors

#: Centroids of a label and best cosines that csls averages.
SUBS, BEST = 7, 5
_SUBS = f"""{VECTORS}, x AS (SELECT label, vec_id % {SUBS} AS sub, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), ci AS (SELECT label, sub, i, median(x) AS m FROM x GROUP BY 1, 2, 3),
c AS (SELECT label::VARCHAR AS label, sub, list(m ORDER BY i) AS e FROM ci GROUP BY 1, 2), s AS (SELECT vec_id AS id, c.label, sub, round(list_cosine_similarity(v.e, c.e), 12) AS sim FROM v, c)"""


def _sub_centres(spark, sf):
    """The medians of each label's vectors by the remainder of their ids: several centroids a label, from all rows."""
    v = vectors(spark, sf).withColumn("part", F.concat_ws("|", F.col("label").cast("string"), (F.col("vec_id") % SUBS).cast("string")))
    return moa.vector_centroids(v, "part", "embedding").withColumn("label", F.split("label", r"\|")[0])


@query("csls_collapsed", f"""WITH {_SUBS}, a AS (SELECT id, avg(sim) AS ra FROM (SELECT id, sim FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC) <= {BEST}) GROUP BY 1),
b AS (SELECT label, sub, avg(sim) AS rb FROM (SELECT label, sub, sim FROM s QUALIFY row_number() OVER (PARTITION BY label, sub ORDER BY sim DESC) <= {BEST}) GROUP BY 1, 2),
k AS (SELECT id, label, max(2 * sim - ra - rb) AS score, 1 - max(sim) AS distance FROM s JOIN a USING (id) JOIN b USING (label, sub) GROUP BY 1, 2)
SELECT id, label, row_number() OVER w AS rank, {r('distance')} AS distance, {r('score')} AS similarity, {r('exp((score - max(score) OVER p) / 0.1) / sum(exp(score / 0.1)) OVER p * exp(max(score) OVER p / 0.1)')} AS confidence,
{r('max(score) OVER p - nth_value(score, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS margin FROM k WINDOW w AS (PARTITION BY id ORDER BY score DESC, label), p AS (PARTITION BY id) QUALIFY rank <= 3""")
def csls_collapsed(spark, sf):
    from wellframe.operators.scoring import score_classes

    return rounded(score_classes(vectors(spark, sf), "vec_id", "embedding", _sub_centres(spark, sf), top=3, scoring="csls", collapse="max", k=BEST))


@query("krylov_components")
def krylov_components(spark, sf):
    """All rows on the leading four components."""
    return rounded(projection.randomised_pca(vectors(spark, sf).select("vec_id", "embedding"), "embedding", 4)[0].drop("embedding"))


@query("centroid_projection")
def centroid_projection(spark, sf):
    """Rows and the centroids of their labels in one plane."""
    return rounded(projection.embedding_with_centroids(vectors(spark, sf), "vec_id", "embedding", centres(spark, sf))[0])


@query("calibration_losses")
def calibration_losses(spark, sf):
    """Losses of a logistic model on the rows held out, before and after calibration."""
    df, names = _flat(spark, sf)
    return rounded(calibration.calibration_report(df, "vec_id", names, "label", "logistic_regression"))


@query("explicit_key_report", """SELECT * FROM (SELECT 'Metadata_Plate' AS target_column, 'p_brand' AS explicit_source_column, 'set_from_explicit_column' AS action, count(p_brand) AS n_non_missing FROM part
UNION ALL SELECT 'Metadata_Well', 'p_type', 'set_from_explicit_column', count(p_type) FROM part UNION ALL SELECT 'Metadata_Source_Plate', '', 'not_requested', 0
UNION ALL SELECT 'Metadata_Source_Well', 'p_name', 'set_from_explicit_column', count(p_name) FROM part)""")
def explicit_key_report(spark, sf):
    return tables.explicit_keys(table(spark, sf, "part"), plate="P_BRAND", well=" p_type", source_well="p_name")[1]

"""Workflows: what a user calls from raw folders to an analysis matrix and beyond.

Each returns ``Result``: the data and a dictionary of audit tables, all lazy
DataFrames. Where a stage must know the data (its medians, which features pass), the
table before it is stored once, so later stages don't compute it again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellframe.operators import anchors, calibration, diagnostics, distance, hierarchy, holdout, keys, latent, models, moa, neighbours, preprocess, profiles, qc, stages, synthetic
from wellframe.operators.graph import stored
from wellframe.operators.latent import Result
from wellframe.sources import tables


def prepare(df: DataFrame) -> DataFrame:
    """Clean names, no leftover index columns, canonical metadata."""
    df, _ = tables.clean_names(df)
    return tables.standardise(df.drop(*tables.sequential_index_columns(df)))[0]


def prepare_metadata(df: DataFrame, label: str = "metadata", plate: str | None = None, well: str | None = None, source_plate: str | None = None, source_well: str | None = None, require_keys: bool = False, legacy: bool = True) -> Result:
    """One metadata or annotation table in canonical form, by named key columns where its headers are ambiguous.

    Raises where an assay key would come from a source column, or, with ``require_keys``,
    where there is no plate or well. Audits: names, dropped, explicit keys, aliases, summary.
    """
    spark = df.sparkSession
    clean, names = tables.clean_names(df)
    dropped = tables.sequential_index_columns(clean)
    keyed, explicit = tables.explicit_keys(clean.drop(*dropped), plate, well, source_plate, source_well)
    out, taken = tables.standardise(keyed)
    wrong = tables.source_like_keys(taken)
    if wrong:
        raise keys.KeyProblem(f"assay keys would be taken from source columns: {wrong}; name the plate and well columns")
    if legacy:
        out = tables.with_legacy_columns(out)
    missing = [k for k in ("Metadata_Plate", "Metadata_Well") if k not in out.columns]
    if require_keys and missing:
        raise keys.KeyProblem(f"{label} has no {missing}; name the plate and well columns")
    has = [F.lit(c in out.columns).alias(f"has_{c}") for c in ("Metadata_Plate", "Metadata_Well", "Metadata_Source_Plate", "Metadata_Source_Well", "Metadata_Compound", "cpd_id")]
    summary = out.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(label).alias("table_label"), "n_rows", F.lit(len(out.columns)).alias("n_columns"), *has)
    audits = {
        "column_names": spark.createDataFrame(names, "original string, cleaned string"), "dropped_index_columns": spark.createDataFrame([(c,) for c in dropped], "column string"),
        "explicit_keys": explicit, "aliases": spark.createDataFrame(taken, "canonical string, taken_from string"), "summary": summary,
    }
    return Result(out, audits)


def inspect_directory(spark: SparkSession, folder: str, recursive: bool = False) -> Result:
    """The catalogue of a folder; audits hold each readable table's column inventory."""
    catalogue = tables.inspect_folder(spark, folder, recursive)
    audits = {}
    for row in catalogue.where("role <> 'unreadable'").collect():  # a row for each file
        audits[Path(row["path"]).name] = qc.column_inventory(tables.read_table(spark, row["path"]))
    return Result(catalogue, audits)


def validate_metadata(spark: SparkSession, path: str, annotations: Sequence[str] = (), merge_keys: Sequence[str] | None = None, policy: str = "error", well_only: bool = False) -> Result:
    """A cleaned metadata table with annotation tables joined on, and reports of keys, duplicates and unmatched rows."""
    out = prepare(tables.read_table(spark, path))
    families = {"assay": ["Metadata_Plate", "Metadata_Well"], "source": ["Metadata_Source_Plate", "Metadata_Source_Well"]}
    audits = {}
    for annotation in annotations:
        label = Path(annotation).name.split(".")[0]
        other = prepare(tables.read_table(spark, annotation))
        on = keys.choose_merge_keys(out.columns, other.columns, merge_keys, well_only)
        audits[f"{label}_duplicates"] = keys.duplicate_key_report(other, on)
        audits[f"{label}_unmatched"] = keys.unmatched_count(out, other, on)
        out = keys.join_checked(out, other, on, label, policy)
    audits["keys"] = keys.validate_keys(out, families)
    return Result(out, audits)


def build_profiles(
    spark: SparkSession, folder: str, recursive: bool = False, image_table: str | None = None, object_tables: Sequence[str] | None = None, metadata_tables: Sequence[str] | None = None,
    statistic: str = "median", duplicate_images: str = "error", duplicate_metadata: str = "error", image_keys: Sequence[str] | None = None, trim: bool = False, keep: float = 0.9,
) -> Result:
    """Raw exports to one profile table: roles by headers, objects aggregated to images, plate maps joined."""
    catalogue = tables.inspect_folder(spark, folder, recursive)
    by_role: dict[str, list[str]] = {}
    for row in catalogue.collect():  # a row for each file
        by_role.setdefault(row["role"], []).append(row["path"])
    full = lambda p: p if Path(p).is_absolute() else str(Path(folder) / p)
    backbone = full(image_table) if image_table else next(iter(by_role.get("image", []) + by_role.get("profile", [])), None)
    if backbone is None:
        raise ValueError("there is no image or profile table")
    out, audits = prepare(tables.read_table(spark, backbone)), {"catalogue": catalogue}
    for path in [full(p) for p in object_tables] if object_tables else by_role.get("object", []):
        label = Path(path).name.split(".")[0]
        objects = prepare(tables.read_table(spark, path))
        objects, status = keys.propagate_keys(objects, out, "ImageNumber", ["Metadata_Plate", "Metadata_Well"])
        on = keys.choose_image_keys(out, objects.columns, image_keys)
        out = keys.collapse_duplicates(out, on, duplicate_images)
        features = [f for f in tables.feature_columns(objects) if f not in on]
        n_in = objects.agg(F.lit(label).alias("table"), F.lit(status).alias("key_status"), F.count(F.lit(1)).alias("n_input_rows"))
        if trim:
            objects = profiles.trim_objects(objects.withColumn("__row", F.xxhash64(*objects.columns)), "__row", on, features, keep).where("keep_object").drop("__row", "score", "threshold", "n_used", "keep_object")
        made = profiles.aggregate_objects(objects, label, on, features, statistic)
        audits[f"{label}_aggregation"] = n_in
        out = keys.join_checked(out, made, on, label)
    for path in [full(p) for p in metadata_tables] if metadata_tables else by_role.get("metadata", []):
        label = Path(path).name.split(".")[0]
        other = prepare(tables.read_table(spark, path))
        on = keys.choose_merge_keys(out.columns, other.columns, None, well_only=True)
        new = [c for c in other.columns if c in on or c not in out.columns]
        audits[f"{label}_unmatched"] = keys.unmatched_count(out, other, on)
        out = keys.join_checked(out, other.select(*new), on, label, duplicate_metadata)
    audits["column_roles"] = spark.createDataFrame(tables.column_roles(out), "column string, role string")
    return Result(out, audits)


def combine_profiles(profile_tables: dict[str, DataFrame], key_columns: Sequence[str] | None = None, how: str = "union", policy: str = "error") -> Result:
    """Profile tables under each other, with checks of the key (by default keys.COMBINED_KEYS); ``policy`` allow keeps duplicates and reports them."""
    ready = {label: prepare(df) for label, df in profile_tables.items()}
    features = {label: tables.feature_columns(df) for label, df in ready.items()}
    out = keys.combine_tables(ready, features, how)
    on = keys.combined_keys([out.columns], key_columns)
    audits = {"duplicates": keys.duplicate_totals(out, on), "key_candidates": keys.key_candidates(out, on, [c for c in out.columns if c.startswith("Metadata_") and c not in on])}
    if policy == "error" and audits["duplicates"].first()["n_duplicate_keys"]:
        best = audits["key_candidates"].where("is_unique").orderBy("n_columns").first()
        raise keys.KeyProblem(f"keys {on} repeat; " + (f"{best['key_columns']} would be unique" if best else "no tried set of columns is unique"))
    return Result(out, audits)


@dataclass(frozen=True)
class Preprocessing:
    """Parameters of ``preprocess_profiles`` in the order in which they act."""

    max_feature_missing: float = 0.2
    min_variance: float = 1e-12
    min_unique: int = 2
    max_zero: float = 1.0
    protected: tuple[str, ...] = ()
    remove_all_zero_rows: bool = True
    zero_tolerance: float = 0.0
    max_sample_missing: float = 0.5
    winsorise: tuple[float | None, float | None] = (None, None)
    reference_method: str = "none"
    reference_column: str | None = None
    reference_values: tuple[str, ...] = ()
    reference_groups: tuple[str, ...] = ()
    indicators: bool = False
    imputation: str = "median"
    imputation_groups: tuple[str, ...] = ()
    batch_centering: str = "none"
    batch_columns: tuple[str, ...] = ()
    correction_batch: str | None = None
    scaling: str = "robust"
    remove_correlated: bool = True
    max_correlation: float = 0.95
    correlation_method: str = "spearman"
    correlation_strategy: str = "variance"
    replicate_columns: tuple[str, ...] = ()
    batch_report_columns: tuple[str, ...] = ()
    id_column: str | None = None
    metadata: tuple[str, ...] | None = None
    features: tuple[str, ...] | None = None
    extra: dict = field(default_factory=dict)


def preprocess_profiles(df: DataFrame, p: Preprocessing = Preprocessing()) -> Result:
    """Profiles to an analysis matrix, stage by stage in a fixed order.

    Sample QC before anything is replaced; non-finite values; feature QC (protected
    features pass unless all missing); all-zero rows; sample filter; winsorising;
    reference QC and normalisation; indicators; imputation; batch centring;
    location/scale correction; scaling; correlation filter; validation. Only lists of
    features and one number for each feature and statistic come to the driver.
    """
    df = stored(prepare(df), "prepared")
    features = tables.feature_columns(df, p.metadata, p.features)
    log: list[tuple[str, str, object, str]] = [("roles", "features", len(features), "numeric columns that are no metadata")]
    audits = {"column_roles": df.sparkSession.createDataFrame(tables.column_roles(df, p.metadata, p.features), "column string, role string")}
    audits["sample_qc"] = qc.sample_qc(df, features, p.max_sample_missing)
    audits["nonfinite"] = qc.nonfinite_report(df, features)
    work = qc.replace_nonfinite(df, features)
    chosen = stored(qc.select_features(qc.feature_qc(work, features), p.max_feature_missing, p.min_variance, p.min_unique, p.max_zero), "feature_qc")
    audits["feature_qc"] = chosen
    rows = chosen.collect()  # a row for each feature
    good = {r["feature"] for r in rows if r["keep"] or (r["feature"] in p.protected and not r["all_missing"])}
    kept = [f for f in features if f in good]
    log.append(("feature_qc", "features_kept", len(kept), f"missing <= {p.max_feature_missing}, variance > {p.min_variance}, values >= {p.min_unique}, zeros <= {p.max_zero}, or protected"))
    work = work.drop(*[f for f in features if f not in good])
    zero = qc.zero_rows(work, kept, p.zero_tolerance)
    audits["all_zero_rows"] = zero.where("all_zero")
    work = (zero.where("NOT all_zero") if p.remove_all_zero_rows else zero).drop("n_observed", "n_zero", "n_nonzero", "all_zero")
    log.append(("rows", "remove_all_zero_rows", p.remove_all_zero_rows, f"zeros are values within {p.zero_tolerance}"))
    work = stored(qc.sample_qc(work, kept, p.max_sample_missing).where("keep_sample").drop("n_missing", "missing_fraction", "keep_sample"), "checked")
    log.append(("rows", "max_sample_missing", p.max_sample_missing, "rows with a larger share of missing features are dropped"))
    work = preprocess.winsorise(work, kept, *p.winsorise)
    if p.reference_column and p.reference_method != "none":
        reference = F.col(p.reference_column).cast("string").isin(*p.reference_values)
        audits["reference_qc"] = preprocess.reference_qc(work, kept, reference, p.reference_groups)
        work = preprocess.reference_normalise(work, kept, reference, p.reference_groups, p.reference_method)
        log.append(("normalisation", p.reference_method, p.reference_column, f"reference values {list(p.reference_values)} within {list(p.reference_groups)}"))
    if p.indicators:
        audits["indicators"] = preprocess.indicator_report(work, kept)
        work = preprocess.missing_indicators(work, kept)
    before = stored(work, "normalised")
    work = impute(before, kept, p)
    log.append(("imputation", p.imputation, len(kept), f"within {list(p.imputation_groups)}"))
    audits["imputation"] = preprocess.imputation_summary(before, work, kept)
    uncorrected = stored(work, "imputed")
    work = uncorrected
    if p.batch_columns:
        work = preprocess.batch_centre(work, kept, p.batch_columns, p.batch_centering)
        log.append(("batch", p.batch_centering, ", ".join(p.batch_columns), "each batch is centred"))
    if p.correction_batch:
        others = [c for c in ("Metadata_Compound", "Metadata_MOA") if c in work.columns]
        if others:
            audits["confounding"] = preprocess.batch_confounding(work, p.correction_batch, others)
        work = preprocess.location_scale(work, kept, p.correction_batch)
        log.append(("batch", "location_scale", p.correction_batch, "each batch gets the overall mean and sd"))
    if p.id_column and (p.replicate_columns or p.batch_report_columns):
        audits |= stages.before_after({"before_batch_correction": uncorrected, "after_batch_correction": work}, p.id_column, kept, p.replicate_columns, p.batch_report_columns)
    work = stored(preprocess.scale(work, kept, p.scaling), "scaled")
    log.append(("scaling", p.scaling, len(kept), "by feature"))
    dropped = df.sparkSession.createDataFrame([], "feature string, retained_feature string, correlation double")
    final = kept
    if p.remove_correlated:
        final, dropped = preprocess.correlation_filter(work, kept, p.max_correlation, p.correlation_method, p.correlation_strategy, p.protected)
        audits["correlation_filter"] = dropped
        work = work.drop(*[f for f in kept if f not in final])
        log.append(("correlation_filter", p.correlation_method, len(kept) - len(final), f"|r| >= {p.max_correlation}, by {p.correlation_strategy}"))
    audits["validation"] = preprocess.validate_matrix(work, final)
    audits["feature_selection"] = preprocess.selection_report(df.sparkSession, features, chosen, dropped, final, p.protected)
    audits["decisions"] = stages.decision_log(df.sparkSession, [*log, ("result", "features", len(final), "features of the final matrix")])
    if p.protected:
        audits["protected"] = preprocess.protected_audit(p.protected, df, features, final)
    return Result(work, audits)


def impute(df: DataFrame, features: Sequence[str], p: Preprocessing) -> DataFrame:
    """The imputation that the parameters name; knn needs ``id_column``."""
    if p.imputation != "knn":
        return preprocess.impute(df, features, p.imputation, p.imputation_groups)
    if not p.id_column:
        raise ValueError("imputation by neighbours needs id_column")
    return preprocess.impute_knn(df, features, p.id_column, groups=p.imputation_groups)


def classical(df: DataFrame, id_col: str, features: Sequence[str], k: int = 8, neighbours: int = 10, metric: str = "cosine", clustering: str = "kmeans", eps: float = 0.5, least: int = 5) -> Result:
    """PCA scores and clusters beside the rows; neighbours, edges, cluster sizes and silhouettes.

    clustering: kmeans, dbscan, or agglomerative_ and a linkage (single, average, complete, ward).
    """
    scored, shares = models.run_pca(df, features, 2)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    if clustering == "kmeans":
        clustered = models.run_kmeans(scored, features, k)
    elif clustering == "dbscan" or clustering.startswith("agglomerative_"):
        if clustering == "dbscan":
            found = models.dbscan(df.select(id_col, vector.alias("__v")), id_col, "__v", eps, least, metric)
        else:
            linkage = clustering.removeprefix("agglomerative_")
            found = hierarchy.agglomerative(df, id_col, features, k, linkage, "euclidean" if linkage == "ward" else metric)
        clustered = scored.join(found.select(F.col("id").alias("__id"), "cluster"), F.col(id_col) == F.col("__id")).drop("__id")
    else:
        raise ValueError(f"unknown clustering {clustering!r}")
    ready = clustered.withColumn("__v", vector)
    near = distance.nearest(ready, id_col, "__v", neighbours, metric)
    audits = {
        "neighbours": near, "edges": distance.topology_edges(near), "cluster_counts": models.cluster_counts(clustered),
        "silhouette": distance.silhouette(ready, id_col, "__v", "cluster", metric),
        "explained_variance": df.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(shares)], "component int, share double"),
    }
    return Result(clustered, audits)


def neighbour_analysis(runs: dict[str, DataFrame], baseline: str, queries: Sequence[str] = (), most: int = 10, k: int | str = "auto", ties: bool = False) -> Result:
    """Neighbour tables of several runs (long or wide) against a baseline: overlap by query, its summary, and lists of the queries asked for.

    Of the first two queries asked for also the neighbours that both have.
    """
    by_query, summary = neighbours.overlap(runs, baseline, k, ties)
    audits = {"overlap_summary": summary}
    if queries:
        audits["top_neighbours"] = neighbours.neighbours_of(runs[baseline], queries, most)
    if len(queries) > 1:
        audits["shared_neighbours"] = distance.shared_neighbours(neighbours.long_neighbours(runs[baseline]), str(queries[0]), str(queries[1]))
    return Result(by_query, audits)


def heatmap(df: DataFrame, id_col: str, features: Sequence[str], mode: str = "feature", metric: str = "cosine") -> Result:
    """The z-scored matrix with rows and columns in the order of their merge trees, as a table; the two orders."""
    matrix, rows, columns = hierarchy.ordered_matrix(df, id_col, features, mode, metric)
    return Result(matrix, {"rows": rows, "columns": columns})


def stability(df: DataFrame, id_col: str, features: Sequence[str], replicate_groups: Sequence[str], ks: Sequence[int] = (2, 4, 8), rounds: int = 50) -> Result:
    """Replicate correlations, neighbour stability and diagnostics by number of clusters."""
    pairs = diagnostics.replicate_pairs(df, id_col, replicate_groups, features)
    return Result(pairs, {"replicates": diagnostics.replicate_summary(pairs, replicate_groups), "neighbours": models.neighbour_stability(df, id_col, features, rounds=rounds), "clusters": models.evaluate_k(df, id_col, features, ks, rounds)})


def batch_effects(df: DataFrame, id_col: str, features: Sequence[str], batch: str, columns: Sequence[str] = (), components: int = 5) -> Result:
    """Batch centroid distances, prediction of the batch, and eta squared of components by metadata."""
    scored, _ = models.run_pca(df, features, components)
    pcs = [c for c in scored.columns if c not in df.columns]
    audits = {f"eta2_{c}": diagnostics.eta_squared(scored, pcs, c) for c in (batch, *columns)}
    try:
        audits["prediction"] = models.cross_validate(df, id_col, features, batch, "random_forest")[1]
    except ValueError as e:
        audits["prediction"] = df.sparkSession.createDataFrame([("not_tested", str(e))], "status string, reason string")
    return Result(diagnostics.batch_centroid_distances(df, batch, features), audits)


def layout(df: DataFrame, well: str, metrics: Sequence[str], axes: Sequence[str] = ()) -> Result:
    """Plate matrices of each metric and summaries by row, column and further axes."""
    placed = diagnostics.plate_positions(df, well)
    columns = sorted(r[0] for r in placed.select("plate_column").distinct().where("plate_column IS NOT NULL").collect())
    audits = {f"matrix_{m}": diagnostics.plate_matrix(placed, m, columns) for m in metrics}
    audits["axes"] = diagnostics.axis_summary(placed, metrics, ["plate_row", "plate_column", *axes])
    return Result(placed, audits)


def drift(df: DataFrame, image: str, features: Sequence[str], least: int = 50) -> Result:
    """Drift statistics of each feature and its summary by image."""
    return Result(diagnostics.drift_statistics(df, image, features, least=least), {"images": qc.image_summary(df, image, features)})


def mechanisms(df: DataFrame, id_col: str, features: Sequence[str], label: str | None = None, metric: str = "cosine", top: int = 5, ks: Sequence[int] = (4, 8, 12)) -> Result:
    """Ranked labels of each profile by class centroids, leave-one-out accuracy, kNN predictions and enrichment.

    Without ``label`` pseudo-anchors stand in for it: clusters of the k of the best silhouette.
    """
    ready = df.withColumn("__v", F.array(*[F.col(f).cast("double") for f in features]))
    extra = {}
    if label is None:
        label = "pseudo_anchor"
        found, extra["anchor_clusters"], extra["anchor_silhouettes"] = anchors.make_pseudo_anchors(ready, id_col, "__v", ks)
        ready = stored(ready.join(found.select(F.col("id").alias("__id"), F.col("anchor").alias(label)), F.col(id_col) == F.col("__id"), "left").drop("__id"), "anchored")
    known = ready.where(F.col(label).isNotNull())
    centroids = moa.vector_centroids(known, label, "__v", least=2)
    scores = moa.centroid_scores(ready, id_col, "__v", centroids, metric, top)
    near = distance.nearest(ready, id_col, "__v", 10, metric)
    loo = moa.leave_one_out(known, id_col, "__v", label, metric)
    audits = {
        "leave_one_out": loo, "loo_summary": moa.classification_summary(moa.confusion(loo)), "knn": moa.knn_classify(known, ready, id_col, "__v", label),
        "enrichment": moa.enrichment(near, known, id_col, label), "summary": moa.prediction_summary(scores.where("rank = 1")), "confidence": moa.confidence_summary(scores.where("rank = 1")),
    }
    return Result(scores, audits | extra)


def latent_space(spark: SparkSession, datasets: dict[str, DataFrame], features: dict[str, Sequence[str]], dims: int = 20, encode=None, id_col: str | None = None, compound: str | None = None, label: str | None = None) -> Result:
    """Datasets aligned, cleaned and embedded: by ``encode(DataFrame, features) -> DataFrame`` or else by PCA, marked so.

    A backend that fails becomes a status, not an error. With ``id_col`` the audits
    hold rates of nearest neighbours of the same compound, label and dataset, mean
    silhouettes of labels and datasets, and warnings.
    """
    shared, report = latent.align_features(spark, features)
    stacked = None
    for name, df in datasets.items():
        one = df.withColumn("Dataset", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    cleaned = latent.clean_and_scale(stacked, shared)
    kept = [r["feature"] for r in cleaned.audits["features"].where("status = 'kept'").collect()]
    status = "pca_fallback"
    out = None
    if encode is not None:
        try:
            out, status = encode(cleaned.data, kept), "backend"
        except Exception as e:  # any failure of a foreign backend is reported
            status = f"backend_failed: {e}"
    if out is None:
        out, _ = models.run_pca(cleaned.data, kept, dims, prefix="latent_")
    audits = {"alignment": report, **cleaned.audits, "status": spark.createDataFrame([(status,)], "status string")}
    warned = [("alignment", w) for w in latent.alignment_warnings(features)]
    if id_col:
        found = latent_facts(out, id_col, {"id": compound, "label": label, "dataset": "Dataset"})
        audits["latent_facts"] = spark.createDataFrame(sorted(found.items()), "fact string, value double")
        warned += [("latent", w) for w in diagnostics.latent_warnings(found)]
    audits["warnings"] = spark.createDataFrame(warned, "stage string, warning string")
    return Result(out, audits)


def latent_facts(df: DataFrame, id_col: str, columns: dict[str, str | None], k: int = 5) -> dict[str, float]:
    """same_x: the share of rows whose nearest neighbour has the same x; silhouette_x: the mean cosine silhouette of x; over the latent_ columns."""
    axes = [c for c in df.columns if c.startswith("latent_")]
    ready = stored(df.select(F.col(id_col).alias("__id"), *[F.col(c).cast("string").alias(x) for x, c in columns.items() if c], F.array(*[F.col(a).cast("double") for a in axes]).alias("__v")), "latent")
    names = [x for x, c in columns.items() if c]
    rates = distance.retrieval_rates(distance.nearest(ready, "__id", "__v", k), ready, "__id", names, k).first()
    out = {f"same_{x}": rates[f"top1_same_{x}"] for x in names}
    for x in ("label", "dataset"):
        if x in names:
            out[f"silhouette_{x}"] = distance.silhouette(ready, "__id", "__v", x, "cosine").agg(F.avg("silhouette")).first()[0]
    return out


def explain(df: DataFrame, id_col: str, features: Sequence[str], query, background=None, test: str = "mw") -> Result:
    """How one compound's rows differ from all others (or a labelled background): statistics and linear contributions."""
    mine = F.upper(F.trim(F.col(id_col).cast("string"))) == str(query).strip().upper()
    side = F.when(mine, True) if background is None else F.when(mine, True).when(background, False)
    side = side.otherwise(False) if background is None else side
    return Result(diagnostics.two_sample_statistics(df, features, side, test), {"contributions": models.linear_contributions(df, features, mine)})


def supervised(df: DataFrame, id_col: str, features: Sequence[str], label: str, names: Sequence[str] = ("knn", "random_forest", "logistic_regression"), folds: int = 5, calibrate: str | None = None) -> Result:
    """Predictions of several models over the same folds; their summaries, and the forest's importances by feature and family.

    ``calibrate`` names a model whose probabilities are compared before and after calibration on held-out rows.
    """
    summaries, predictions = models.compare_models(df, id_col, features, label, names, folds)
    importance = models.tree_importance(df, features, label)
    extra = {"calibration": calibration.calibration_report(df, id_col, features, label, calibrate)} if calibrate else {}
    return Result(predictions, {"models": summaries, "importance": importance, "families": models.importance_by_family(importance)} | extra)


def drift_by_compartment(spark: SparkSession, folder: str, image: str, features: Sequence[str] | None = None, most: int | None = None, least: int = 50) -> dict[str, Result]:
    """Drift of each compartment's tables in a folder, by compartment; tables without the image column are left out.

    Without ``features`` all of a compartment's are taken, or its first ``most``; given
    ones that a compartment lacks raise.
    """
    out = {}
    for compartment, paths in tables.compartment_files(folder).items():
        stacked = None
        for path in paths:
            one = tables.read_table(spark, path)
            if image in one.columns:
                stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
        if stacked is None:
            continue
        asked = list(features) if features else drift_features(stacked, image, most)
        if absent := [f for f in asked if f not in stacked.columns]:
            raise KeyError(f"{compartment} has no features {absent}")
        if asked:
            out[compartment] = drift(stacked, image, asked, least)
    return out


def drift_features(df: DataFrame, image: str, most: int | None = None) -> list[str]:
    """The features of a table in its own order, or the first ``most``."""
    return [f for f in tables.feature_columns(df) if f != image][:most]


def synthetic_benchmark(spark: SparkSession, names: Sequence[str] = tuple(synthetic.SCENARIOS), base: synthetic.SyntheticConfig = synthetic.SyntheticConfig(), seeds: Sequence[int] = (42,), dims: int = 20, fraction: float = 0.15, encode=None) -> Result:
    """Scenarios generated, perturbed, cleaned and embedded; how held-out rows find their compounds; a decision on each.

    Methods are the scaled features (raw), their principal components (pca) and, where
    given, ``encode(DataFrame, features) -> DataFrame`` with latent_ columns (backend),
    which is the one judged; without it pca is. Training rows never stand for held-out ones.
    """
    judged = "backend" if encode is not None else "pca"
    columns = {"compound": "cpd_id", "moa": "cpd_type", "dataset": "Dataset", "batch": "synthetic_batch"}
    sets = [(name, seed) for name in names for seed in seeds]
    features, made = synthetic.feature_names(base), []
    # all scenarios are rows of one table, so that each step is one job for all of them
    for at, (name, seed) in enumerate(sets):
        config = synthetic.scenario(name, replace(base, seed=seed))
        one = synthetic.perturbed_vectors(synthetic.profile_vectors(spark, config), features, config)
        made.append(one.select(F.lit(name).alias("scenario"), F.lit(seed).alias("seed"), (F.col("Sample") * len(sets) + at).alias("row"), "Sample", *columns.values(), "vector"))
    cleaned = latent.clean_and_scale_vectors(reduce(DataFrame.union, made), "vector", ["scenario", "seed"])
    stratum = cleaned.data.withColumn("stratum", F.concat_ws("|", "scenario", "seed", "cpd_id"))
    split = stored(latent.validation_split(stratum, "row", "stratum", fraction).drop("stratum"), "cleaned")
    kept: dict[tuple, list[str]] = {}
    for r in cleaned.audits["features"].where("status = 'kept'").orderBy("scenario", "seed", "place").collect():
        kept.setdefault((r["scenario"], r["seed"]), []).append(features[r["place"]])
    spaces = [split.withColumn("method", F.lit("raw"))]
    for name, seed in sets:
        own = split.where((F.col("scenario") == name) & (F.col("seed") == seed))
        spaces.append(models.pca_of_vectors(own, "vector", dims, "scores").withColumn("vector", F.col("scores")).drop("scores").withColumn("method", F.lit("pca")))
        if encode is not None:
            wanted = kept.get((name, seed), [])
            coded = encode(own.select(*own.drop("vector").columns, *[F.col("vector")[i].alias(f) for i, f in enumerate(wanted)]), wanted)
            axes = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in coded.columns if c.startswith("latent_")])
            spaces.append(coded.withColumn("vector", axes).withColumn("method", F.lit("backend")).select(*spaces[0].columns))
    # a row is one in each space, and has an id of its own there
    space = stored(reduce(DataFrame.unionByName, spaces).withColumn("row", F.concat_ws("|", "method", "row")), "spaces")
    found = holdout.retrieval_within(space, "row", "vector", columns, F.col("split") == "validation", ["scenario", "seed", "method"])
    metrics = stored(found.select("scenario", F.col("seed").cast("int").alias("seed"), "method", "metric", "value"), "metrics")
    scores = holdout.score_scenarios(metrics, judged)
    return Result(holdout.summarise_scenarios(metrics, scores, judged), {"metrics": metrics, "checks": scores})


def strategy_summary(spark: SparkSession, root: str, batch: str = "Metadata_Plate", compound: str = "Metadata_Compound", path: str | None = None) -> Result:
    """Strategies of preprocessing ranked by their report folders, written to ``path`` if there is one."""
    out = latent.summarise_strategies(spark, root, batch, compound)
    if path:
        tables.write_table(out, path, single=True)
    return Result(out)

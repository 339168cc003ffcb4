"""Transforms from raw features to an analysis matrix.

Each takes and returns a DataFrame; what they need to know of the data (medians,
ranges) are tables of one row a feature or group, computed by Spark and joined or
folded in as literals, one for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellframe.functions.quantiles import exact_quantiles
from wellframe.functions.shapes import to_long
from wellframe.functions.stats import clean, correlation, median, quantile

from . import gram
from .distance import block_rows
from .graph import stored
from .qc import join_groups


def facts(df: DataFrame, features: Sequence[str], **aggregates) -> dict[str, dict[str, float | None]]:
    """{feature: {name: value}} from one aggregation; a number for each feature and name comes to the driver."""
    if not features:
        return {}
    x = F.col("value")
    rows = to_long(df, [], features).groupBy("feature").agg(*[make(x).alias(name) for name, make in aggregates.items()]).collect()
    found = {r["feature"]: {name: r[name] for name in aggregates} for r in rows}
    return {f: found.get(f, dict.fromkeys(aggregates)) for f in features}


def quantile_facts(df: DataFrame, features: Sequence[str], large: bool = False, **probabilities: float) -> dict[str, dict[str, float | None]]:
    """{feature: {name: exact quantile}}.

    ``large``: for tables of more than some 10**8 rows, where one buffer must not hold
    a feature's distinct values; quantiles are bracketed by a sketch first.
    """
    if not large:
        return facts(df, features, **{name: (lambda x, p=p: quantile(x, p)) for name, p in probabilities.items()})
    found = exact_quantiles(to_long(df, [], features), ["feature"], "value", sorted(set(probabilities.values()))).collect()
    at = {(r["feature"], r["probability"]): r["quantile"] for r in found}
    return {f: {name: at.get((f, p)) for name, p in probabilities.items()} for f in features}


def winsorise(df: DataFrame, features: Sequence[str], lower: float | None = None, upper: float | None = None, large: bool = False) -> DataFrame:
    """Clips each feature to its exact quantiles; missing values stay missing."""
    asked = {name: p for name, p in (("low", lower), ("high", upper)) if p is not None}
    if not asked:
        return df
    known = quantile_facts(df, features, large, **asked)

    def clip(f: str) -> Column:
        x = F.col(f).cast("double")
        low, high = known[f].get("low"), known[f].get("high")
        out = x if low is None else F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
        return out if high is None else F.when(x.isNotNull(), F.least(out, F.lit(high)))

    return df.withColumns({f: clip(f) for f in features})


def winsorise_report(df: DataFrame, features: Sequence[str], lower: float, upper: float) -> DataFrame:
    """feature, low, high and how many values lie beyond."""
    x = F.col("value")
    long = to_long(df, [], features)
    limits = long.groupBy("feature").agg(quantile(x, lower).alias("low"), quantile(x, upper).alias("high"))
    beyond = long.join(F.broadcast(limits), "feature").groupBy("feature", "low", "high")
    return beyond.agg(F.count_if(x < F.col("low")).alias("n_low"), F.count_if(x > F.col("high")).alias("n_high"))


def group_facts(df: DataFrame, groups: Sequence[str], features: Sequence[str], make, prefix: str) -> DataFrame:
    """A row for each group with ``make(column)`` for each feature, named prefix + feature."""
    return df.groupBy(*groups).agg(*[make(F.col(f).cast("double")).alias(prefix + f) for f in features])


def reference_normalise(
    df: DataFrame, features: Sequence[str], reference: Column, groups: Sequence[str] = (), method: str = "robust_z", least: int = 2, floor: float = 1e-9
) -> DataFrame:
    """Centres and scales each group by its reference rows.

    robust_z: median and raw MAD; median_center: median only; zscore: mean and sd
    (n-1); none: nothing. A scale under ``floor`` counts as 1. Groups with fewer than
    ``least`` reference rows stay as they are.
    """
    if method == "none":
        return df
    if method not in ("robust_z", "median_center", "zscore"):
        raise ValueError(f"unknown method {method}")
    ref = F.coalesce(reference, F.lit(False))
    inside = df.where(ref)
    centre = F.avg if method == "zscore" else median
    table = inside.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), *[centre(F.col(f).cast("double")).alias("__c_" + f) for f in features])
    if method == "robust_z":
        off = join_groups(inside, table.drop("__n"), groups)
        spread = off.groupBy(*groups).agg(*[median(F.abs(F.col(f).cast("double") - F.col("__c_" + f))).alias("__s_" + f) for f in features])
        table = join_groups(table, spread, groups)
    elif method == "zscore":
        spread = group_facts(inside, groups, features, F.stddev_samp, "__s_")
        table = join_groups(table, spread, groups)
    joined = join_groups(df, table, groups)

    def normal(f: str) -> Column:
        x = F.col(f).cast("double")
        out = x - F.col("__c_" + f)
        if method != "median_center":
            s = F.col("__s_" + f)
            out = out / F.when(F.abs(s) >= floor, s).otherwise(1.0)
        return F.when((F.col("__n") >= least) & F.col("__c_" + f).isNotNull(), out).otherwise(x)

    out = joined.withColumns({f: normal(f) for f in features})
    return out.select(*df.columns)


def reference_qc(df: DataFrame, features: Sequence[str], reference: Column, groups: Sequence[str] = (), floor: float = 1e-8, least: int = 2) -> DataFrame:
    """For each group: rows, reference rows and their share, features whose reference MAD is at most ``floor``,
    the median over features of missing fractions among references, and a status."""
    ref = F.coalesce(reference, F.lit(False))
    marked = df.withColumn("__ref", ref)
    size = marked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_profiles"), F.sum(F.col("__ref").cast("bigint")).alias("n_reference"))
    long = to_long(marked.where("__ref"), groups, features)
    x = F.col("value")
    centre = long.groupBy(*groups, "feature").agg(median(x).alias("__c"), F.avg(x.isNull().cast("double")).alias("missing"))
    spread = join_groups(long, centre.select(*groups, "feature", "__c"), [*groups, "feature"]).groupBy(*groups, "feature").agg(median(F.abs(x - F.col("__c"))).alias("mad"))
    by_feature = join_groups(centre, spread, [*groups, "feature"])
    by_group = by_feature.groupBy(*groups).agg(F.count_if(F.col("mad") <= floor).alias("n_flat_features"), median(F.col("missing")).alias("median_missing_fraction"))
    out = join_groups(size, by_group, groups)
    n = F.col("n_reference")
    status = F.when(n == 0, "no_reference").when(n < least, "too_few").when(F.coalesce(F.col("n_flat_features"), F.lit(0)) > 0, "review").otherwise("ok")
    return out.withColumn("reference_fraction", n / F.col("n_profiles")).withColumn("status", status)


def missing_indicators(df: DataFrame, features: Sequence[str], most: int | None = None, least_fraction: float = 0.0) -> DataFrame:
    """Adds MissingIndicator__f for each feature whose missing fraction is above ``least_fraction``; ``most`` keeps those of the largest (see ``indicator_report``)."""
    able = indicated(facts(df, features, missing=lambda x: F.avg(x.isNull().cast("double"))), features, most, least_fraction)
    return df.withColumns({f"MissingIndicator__{f}": F.col(f).isNull().cast("int") for f in able})


def indicated(known: dict, features: Sequence[str], most: int | None, least_fraction: float) -> list[str]:
    return sorted((f for f in features if (known[f]["missing"] or 0) > least_fraction), key=lambda f: (-known[f]["missing"], f))[:most]


def indicator_report(df: DataFrame, features: Sequence[str], most: int | None = None, least_fraction: float = 0.0) -> DataFrame:
    """feature, missing_fraction and status of every feature: indicated, below_limit, or left_out where ``most`` was reached."""
    known = facts(df, features, missing=lambda x: F.avg(x.isNull().cast("double")))
    able, taken = set(indicated(known, features, None, least_fraction)), set(indicated(known, features, most, least_fraction))
    rows = [(f, float(known[f]["missing"] or 0.0), "indicated" if f in taken else "left_out" if f in able else "below_limit") for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, missing_fraction double, status string")


def impute(df: DataFrame, features: Sequence[str], method: str = "median", groups: Sequence[str] = (), large: bool = False) -> DataFrame:
    """Fills missing values: median, mean, zero, group_median or group_mean (then the overall one, then 0)."""
    if method == "zero":
        return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    kind = method.removeprefix("group_")
    if kind not in ("median", "mean"):
        raise ValueError(f"unknown method {method}")
    make = median if kind == "median" else F.avg
    known = quantile_facts(df, features, large, value=0.5) if kind == "median" else facts(df, features, value=make)
    fill = {f: F.lit(float(known[f]["value"]) if known[f]["value"] is not None else 0.0) for f in features}
    if not method.startswith("group_"):
        return df.withColumns({f: F.coalesce(F.col(f).cast("double"), fill[f]) for f in features})
    joined = join_groups(df, group_facts(df, groups, features, make, "__m_"), groups)
    return joined.withColumns({f: F.coalesce(F.col(f).cast("double"), F.col("__m_" + f), fill[f]) for f in features}).select(*df.columns)


#: Numbers of a block, and pairs of an asked row and another that are looked at together.
BLOCK_NUMBERS, PAIRS_AT_ONCE = 1 << 19, 1 << 20


def _nearest_of_pattern(q: np.ndarray, b: np.ndarray, bi: np.ndarray, shared: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of b, distance) of the k nearest rows of b to each of q over the features ``shared``, ties to the smaller id.

    Rows are ordered by the widest feature. The nearest of a few rows on either side bound
    the distance of the k-th, and only rows within that bound along the feature are compared.
    """
    factor, along = q.shape[1] / len(shared), shared[b[:, shared].std(0).argmax()]
    order = np.lexsort((bi, b[:, along]))
    edge, x, y = b[order, along], q[:, shared], b[np.ix_(order, shared)]
    far = lambda i, j: np.round(np.sqrt(((x[i] - y[j]) ** 2).sum(-1) * factor), 12)
    span, step, out = min(len(b), 8 * k), max(1, PAIRS_AT_ONCE // (8 * k * len(shared))), []
    for low in range(0, len(q), step):
        asked = np.arange(low, min(low + step, len(q)))
        value = q[asked, along]
        start = np.clip(np.searchsorted(edge, value) - span // 2, 0, len(b) - span)
        bound = np.full(len(asked), np.inf)
        if span > k:
            bound = np.partition(far(asked[:, None], start[:, None] + np.arange(span)[None, :]), k - 1, axis=1)[:, k - 1]
        # rounding must not lose a tie
        wide = bound / np.sqrt(factor) * (1 + 1e-9) + 1e-9 + np.abs(value) * 1e-14
        first, last = np.searchsorted(edge, value - wide, "left"), np.searchsorted(edge, value + wide, "right")
        for at, (i, one, two) in enumerate(_slices(first, last, max(1, PAIRS_AT_ONCE // len(shared)))):
            j = np.repeat(one - np.concatenate([[0], np.cumsum(two - one)[:-1]]), two - one) + np.arange((two - one).sum())
            rows = np.repeat(i, two - one)
            d = far(asked[rows], j)
            keep = d <= bound[rows]
            out.append((asked[rows[keep]], order[j[keep]], d[keep]))
            if at % 16 == 15:
                out = [_first(bi, k, *map(np.concatenate, zip(*out)))]
    return _first(bi, k, *map(np.concatenate, zip(*out)))


def _slices(first: np.ndarray, last: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and the ranges that they ask for, some rows at a time or parts of one row's range, of about ``most`` places."""
    ends = np.cumsum(last - first)
    at = 0
    while at < len(first):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        if upto == at + 1:
            for low in range(int(first[at]), int(last[at]), most):
                yield np.array([at]), np.array([low]), np.array([min(low + most, int(last[at]))])
        else:
            yield np.arange(at, upto), first[at:upto], last[at:upto]
        at = upto


def _first(bi: np.ndarray, k: int, row: np.ndarray, other: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (d, id) of each row."""
    order = np.lexsort((bi[other], d, row))
    row, other, d = row[order], other[order], d[order]
    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))
    return row[place < k], other[place < k], d[place < k]


def _patterns(known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pattern of known features and its rows."""
    kinds, of = np.unique(known, axis=0, return_inverse=True)
    for i, kind in enumerate(kinds):
        yield kind, np.flatnonzero(of.ravel() == i)


def _nearest_values(neighbours: int):
    """Of a block of asked rows and one of their group: for each missing value the nearest rows that have it.

    Rows with the same known features are compared together, so that each search has a
    fixed set of features. A row that has the value is never the asked one itself.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(len(f)):
                r = f.iloc[at]
                qi, bi = np.asarray(r["q_ids"]), np.asarray(r["b_ids"])
                q, b = block_rows(r["q"], len(qi)), block_rows(r["b"], len(bi))
                theirs = list(_patterns(~np.isnan(b)))
                for has, asked in _patterns(~np.isnan(q)):
                    for kind, rows in theirs:
                        shared, given = np.flatnonzero(has & kind), np.flatnonzero(~has & kind)
                        if not len(shared) or not len(given):
                            continue
                        i, j, d = _nearest_of_pattern(q[asked], b[rows], bi[rows], shared, neighbours)
                        i, j = asked[i], rows[j]
                        for c in given:
                            yield pd.DataFrame({"q": qi[i], "f": np.full(len(i), c, np.int32), "d": d, "id": bi[j], "value": b[j, c]})

    return run


def impute_knn(df: DataFrame, features: Sequence[str], id_col: str, neighbours: int = 5, groups: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Fills each missing value by the mean of the nearest rows that have it (nan-Euclidean), then the median.

    Distances take the features that both rows have, scaled up to all of them; equal
    ones go to the smaller id. Rows of a group that are alike are one asked row, and of
    those to choose from the ``neighbours`` of least id stay. Blocks of rows with
    something missing meet the blocks of their group; a pair of blocks gives
    ``neighbours`` rows a missing value at most, and the best of these are kept. Rows
    without an id, or with nothing known, are filled by the median alone. The table is
    stored once.
    """
    held = stored(df, "imputed")
    medians = quantile_facts(held, features, False, value=0.5)
    missing = F.lit(float("nan"))
    v = F.array(*[F.coalesce(clean(F.col(f), float("inf")), missing) + F.lit(0.0) for f in features])
    group = F.to_json(F.struct(*[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)])) if groups else F.lit("")
    rows = held.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), group.alias("g"), v.alias("v"))
    id_type = rows.schema["id"].dataType
    block = block or max(512, min(1 << 17, BLOCK_NUMBERS // max(1, len(features))))

    def dealt(part: DataFrame, name: str, most: int) -> DataFrame:
        sizes = part.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks"))
        placed = part.join(sizes, "g").groupBy("g", F.pmod(F.xxhash64("id"), F.col("blocks")).alias(f"{name}_at"))
        return placed.agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(name))

    alike = rows.withColumn("k", F.row_number().over(Window.partitionBy("g", "v").orderBy("id"))).where(F.col("k") <= neighbours)
    kept = stored(alike, "rows")
    asked = kept.where((F.col("k") == 1) & F.exists("v", F.isnan) & F.exists("v", lambda x: ~F.isnan(x)))
    pairs = dealt(asked.drop("k"), "q", min(block, 8192)).join(dealt(kept.drop("k"), "b", block), "g").repartition("g", "q_at", "b_at").select("q_ids", "q", "b_ids", "b")
    schema = T.StructType([T.StructField("q", id_type), *T.StructType.fromDDL("f int, d double"), T.StructField("id", id_type), T.StructField("value", T.DoubleType())])
    near = pairs.mapInPandas(_nearest_values(neighbours), schema)
    best = near.withColumn("k", F.row_number().over(Window.partitionBy("q", "f").orderBy("d", "id"))).where(F.col("k") <= neighbours)
    means = best.groupBy("q", "f").agg(F.avg("value").alias("m")).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("f", "m"))).alias("__found"))
    found = asked.join(means, asked["id"] == means["q"]).select(F.col("g").alias("__g"), F.col("v").alias("__v"), "__found")
    gaps = F.exists("__w", F.isnan)
    ready = held.withColumns({"__w": v, "__h": group})
    joined = ready.join(found, F.col(id_col).isNotNull() & gaps & (F.col("__h") == F.col("__g")) & (F.col("__w") == F.col("__v")), "left")

    def filled(i: int, f: str) -> Column:
        x, fill = F.col(f).cast("double"), medians[f]["value"]
        return F.coalesce(F.when(F.col(id_col).isNotNull(), F.coalesce(clean(F.col(f), float("inf")), F.try_element_at("__found", F.lit(i)))), x, F.lit(float(fill) if fill is not None else 0.0))

    return joined.withColumns({f: filled(i, f) for i, f in enumerate(features)}).select(*df.columns)


def imputation_summary(before: DataFrame, after: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing values, median and sd of each feature before and after."""
    x = F.col("value")

    def side(df: DataFrame, name: str) -> DataFrame:
        return to_long(df, [], features).groupBy("feature").agg(
            F.sum(x.isNull().cast("bigint")).alias(f"{name}_missing"), median(x).alias(f"{name}_median"), F.stddev_samp(x).alias(f"{name}_sd")
        )

    return side(before, "before").join(side(after, "after"), "feature")


def batch_centre(df: DataFrame, features: Sequence[str], batches: Sequence[str], method: str = "median") -> DataFrame:
    """Subtracts each batch's median or mean."""
    if method == "none":
        return df
    make = {"median": median, "mean": F.avg}[method]
    joined = join_groups(df, group_facts(df, batches, features, make, "__m_"), batches)
    return joined.withColumns({f: F.col(f).cast("double") - F.col("__m_" + f) for f in features}).select(*df.columns)


def location_scale(df: DataFrame, features: Sequence[str], batch: str, least: int = 3, floor: float = 1e-8) -> DataFrame:
    """(x - batch mean) / batch sd * overall sd + overall mean; batches under ``least`` rows stay as they are."""
    known = facts(df, features, mean=F.avg, sd=F.stddev_samp)
    table = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(F.col(f).cast("double")).alias("__m_" + f) for f in features], *[F.stddev_samp(F.col(f).cast("double")).alias("__s_" + f) for f in features]
    )
    joined = join_groups(df, table, [batch])

    def moved(f: str) -> Column:
        sd, mean = known[f]["sd"] or 1.0, known[f]["mean"] or 0.0
        s = F.when(F.col("__s_" + f) > floor, F.col("__s_" + f)).otherwise(1.0)
        x = F.col(f).cast("double")
        return F.when(F.col("__n") >= least, (x - F.col("__m_" + f)) / s * sd + mean).otherwise(x)

    return joined.withColumns({f: moved(f) for f in features}).select(*df.columns)


def batch_confounding(df: DataFrame, batch: str, protected: Sequence[str]) -> DataFrame:
    """For each protected column: how its labels lie over batches, and a status.

    high_risk: every label in one batch, or every batch with one label. review: some
    labels or batches are so. Else ok.
    """
    out = None
    for column in protected:
        pairs = df.where(F.col(column).isNotNull() & F.col(batch).isNotNull()).select(F.col(batch).alias("b"), F.col(column).cast("string").alias("v")).distinct()
        by_label = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_labels"), F.count_if(F.col("n") == 1).alias("n_labels_in_one_batch"))
        by_batch = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_batches"), F.count_if(F.col("n") == 1).alias("n_batches_of_one_label"))
        row = by_label.crossJoin(by_batch)
        full = ((F.col("n_labels_in_one_batch") == F.col("n_labels")) | (F.col("n_batches_of_one_label") == F.col("n_batches"))) & (F.col("n_batches") > 1)
        some = (F.col("n_labels_in_one_batch") > 0) | (F.col("n_batches_of_one_label") > 0)
        row = row.select(F.lit(column).alias("protected_column"), "n_labels", "n_batches", "n_labels_in_one_batch", "n_batches_of_one_label", F.when(full, "high_risk").when(some & (F.col("n_batches") > 1), "review").otherwise("ok").alias("status"))
        out = row if out is None else out.union(row)
    return out


def scale(df: DataFrame, features: Sequence[str], method: str = "robust", large: bool = False) -> DataFrame:
    """robust: median and interquartile range; standard: mean and sd (n); minmax; none. A zero scale counts as 1."""
    if method == "none":
        return df
    if method == "robust":
        known = quantile_facts(df, features, large, centre=0.5, low=0.25, high=0.75)
    elif method == "standard":
        known = facts(df, features, centre=F.avg, high=F.stddev_pop)
    elif method == "minmax":
        known = facts(df, features, centre=F.min, low=F.min, high=F.max)
    else:
        raise ValueError(f"unknown method {method}")

    def scaled(f: str) -> Column:
        k = known[f]
        width = (k["high"] or 0.0) - (k.get("low") or 0.0)
        return (F.col(f).cast("double") - (k["centre"] or 0.0)) / (width if width else 1.0)

    return df.withColumns({f: scaled(f) for f in features})


def correlation_pairs(df: DataFrame, features: Sequence[str], method: str = "pearson") -> DataFrame:
    """feature_a before feature_b and their correlation over the rows that have both (0 where one is constant).

    spearman ranks each feature over all its known values; kendall is tau-b. A few
    features are one aggregation, more of them go by blocks of columns (see ``gram``),
    with the same result.
    """
    if method == "kendall":
        return gram.kendall_pairs(df, features)
    if method == "spearman":
        df = gram.ranked(df, features)
    elif method != "pearson":
        raise ValueError(f"unknown method {method}")
    if len(features) > NARROW:
        return gram.correlations(df, features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    value = lambda f: clean(F.col(f), float("inf"))
    made = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.coalesce(correlation(value(a), value(b)), F.lit(0.0)).alias("correlation")) for a, b in pairs]
    return df.agg(F.array(*made).alias("x")).select(F.explode("x").alias("x")).select("x.*")


#: Features whose pairs are columns of one aggregation.
NARROW = 12


def correlation_filter(
    df: DataFrame, features: Sequence[str], threshold: float = 0.95, method: str = "spearman", strategy: str = "variance", protected: Sequence[str] = ()
) -> tuple[list[str], DataFrame]:
    """(retained features, report of those dropped): a greedy scan in order of priority, for any number of features.

    strategy: variance (largest first), mean_correlation (least first) or order. A
    feature is dropped if its |r| with a retained one reaches the threshold; the
    report names the retained one of largest |r|. The scan is over features, not rows,
    and runs on the driver, which sees only the pairs that reach the threshold.
    """
    schema = "feature string, retained_feature string, correlation double"
    if len(features) < 2:
        return list(features), df.sparkSession.createDataFrame([], schema)
    pairs = stored(correlation_pairs(df, features, method).withColumn("r", F.abs("correlation")).select("feature_a", "feature_b", "r"), "correlations")
    near: dict[str, list[tuple[str, float]]] = {f: [] for f in features}
    for x in pairs.where(F.col("r") >= threshold).toLocalIterator():
        near[x["feature_a"]].append((x["feature_b"], x["r"]))
        near[x["feature_b"]].append((x["feature_a"], x["r"]))
    if strategy == "variance":
        known = facts(df, features, value=F.var_samp)
        weight = {f: -(known[f]["value"] or 0.0) for f in features}
    elif strategy == "mean_correlation":
        both = pairs.select(F.col("feature_a").alias("f"), "r").union(pairs.select("feature_b", "r"))
        weight = {x["f"]: x["r"] for x in both.groupBy("f").agg((F.sum("r") / (len(features) - 1)).alias("r")).collect()}  # a row a feature
    else:
        weight = dict.fromkeys(features, 0.0)
    place: dict[str, int] = {}
    dropped = []
    for f in sorted(features, key=lambda f: (f not in protected, weight[f])):
        held = max(((r, -place[g], g) for g, r in near[f] if g in place), default=None)
        if f not in protected and held is not None:
            dropped.append((f, held[2], float(held[0])))
        else:
            place[f] = len(place)
    return [f for f in features if f in place], df.sparkSession.createDataFrame(dropped, schema)


def selection_report(spark: SparkSession, features: Sequence[str], feature_qc: DataFrame, dropped: DataFrame, final: Sequence[str], protected: Sequence[str] = ()) -> DataFrame:
    """feature, retained, protected, reason and detail of every feature that the preprocessing began with.

    feature_qc: from ``select_features``; dropped: from ``correlation_filter``.
    reason: retained, or why it went: the first rule of the feature QC that it fails
    (all_missing, too_missing, low_variance, few_values, too_many_zeros), correlated
    (detail: the retained feature and r), or not_in_final_matrix.
    """
    start = spark.createDataFrame([(f, i, f in set(final), f in set(protected)) for i, f in enumerate(features)], "feature string, at int, retained boolean, protected boolean")
    rules = {"all_missing": F.col("all_missing"), "too_missing": ~F.col("keep_missing"), "low_variance": ~F.col("keep_variance"), "few_values": ~F.col("keep_unique"), "too_many_zeros": ~F.col("keep_zero")}
    failed = feature_qc.select("feature", F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules.items()]).alias("rule"))
    why = dropped.select("feature", F.concat_ws(" ", "retained_feature", F.format_number("correlation", 4)).alias("pair"))
    joined = start.join(failed, "feature", "left").join(why, "feature", "left")
    reason = F.when(F.col("retained"), "retained").when(F.col("pair").isNotNull(), "correlated").otherwise(F.coalesce("rule", F.lit("not_in_final_matrix")))
    return joined.select("feature", "retained", "protected", reason.alias("reason"), F.when(~F.col("retained"), F.col("pair")).alias("detail"))


def protected_audit(requested: Sequence[str], df: DataFrame, features: Sequence[str], final: Sequence[str]) -> DataFrame:
    """What became of each protected feature: absent, not_numeric, all_missing, kept or lost."""
    known = facts(df, [f for f in requested if f in features], n=F.count)

    def status(f: str) -> str:
        if f not in df.columns:
            return "absent"
        if f not in features:
            return "not_numeric"
        if not known[f]["n"]:
            return "all_missing"
        return "kept" if f in final else "lost"

    return df.sparkSession.createDataFrame([(f, status(f)) for f in dict.fromkeys(requested)], "feature string, status string")


def validate_matrix(df: DataFrame, features: Sequence[str], context: str = "final feature matrix") -> DataFrame:
    """One row: context, n_rows, n_features, n_bad_values, status; raises where the matrix is empty or not finite."""
    bad = sum((F.coalesce(~(F.abs(F.col(f).cast("double")) < float("inf")), F.lit(True)).cast("bigint") for f in features), F.lit(0))
    out = df.agg(F.lit(context).alias("context"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(features)).alias("n_features"), F.coalesce(F.sum(bad), F.lit(0)).alias("n_bad_values"))
    row = out.first()
    if not features or not row["n_rows"] or row["n_bad_values"]:
        raise ValueError(f"{context}: {row['n_rows']} rows, {len(features)} features, {row['n_bad_values']} missing or infinite values")
    return out.withColumn("status", F.lit("ok"))


#: Families of features by parts of their names, the first that fits (fixed values).
FAMILIES = {
    "Intensity": ("intensity",),
    "Texture": ("texture",),
    "AreaShape": ("areashape",),
    "Granularity": ("granularity",),
    "RadialDistribution": ("radialdistribution",),
    "Correlation": ("correlation",),
    "Neighbors": ("neighbors",),
    "Location": ("location",),
    "MissingnessIndicator": ("missingindicator__",),
}

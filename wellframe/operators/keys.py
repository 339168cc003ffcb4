"""Keys, duplicates and joins whose cardinality is checked."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("error", "first", "identical")


class KeyProblem(ValueError):
    """A join key that is missing, ambiguous or not unique."""


def same_keys(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return on


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows share: n_rows and the columns on which those rows differ."""
    others = [c for c in df.columns if c not in keys]
    differs = [F.when(F.count_distinct(F.col(c).cast("string")) > 1, F.lit(c)) for c in others]
    conflicts = F.concat_ws(",", F.array_compact(F.array(*differs))) if others else F.lit("")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), conflicts.alias("conflicting_columns")).where("n_rows > 1")


def duplicate_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_duplicate_rows in n_duplicate_keys."""
    many = key_counts(df, keys).where("n_rows > 1")
    return many.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_duplicate_rows"), F.count(F.lit(1)).alias("n_duplicate_keys"))


def collapse_duplicates(df: DataFrame, keys: Sequence[str], policy: str = "error", order: Sequence[str] = ()) -> DataFrame:
    """One row for each key.

    error: raises if a key repeats. first: the first row in ``order`` (all columns
    where none is given). identical: rows of a key must agree wherever they have
    values, and are merged. ``first`` and ``identical`` aggregate, so a hot key is
    reduced before the shuffle.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    others = [c for c in df.columns if c not in keys]
    if policy == "first":
        # null-valued order columns come first, as in an ascending sort
        rank = F.struct(*[F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("value")) for c in (order or df.columns)])
        out = df.groupBy(*keys).agg(F.min_by(F.struct(*others) if others else F.struct(F.lit(1)), rank).alias("row"))
        return out.select(*[F.col(c) if c in keys else F.col(f"row.`{c}`").alias(c) for c in df.columns])
    if policy == "error":
        if not key_counts(df, keys).where("n_rows > 1").isEmpty():
            raise KeyProblem(f"several rows share a key of {list(keys)}")
        return df
    if not duplicate_key_report(df, keys).where("conflicting_columns <> ''").isEmpty():
        raise KeyProblem(f"rows that share a key of {list(keys)} disagree")
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in others]).select(*df.columns)


def validate_keys(df: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """For each family of key columns: status ok, review or missing; unique keys, duplicate and incomplete rows."""
    spark = df.sparkSession
    out = None
    for name, keys in families.items():
        if not set(keys) <= set(df.columns):
            row = spark.createDataFrame([(name, "missing", 0, 0, 0)], "family string, status string, n_keys bigint, n_duplicate_rows bigint, n_incomplete_rows bigint")
        else:
            empty = F.lit(False)
            for k in keys:
                empty = empty | F.col(k).isNull()
            counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("empty", empty)
            row = counts.agg(
                F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicate_rows"),
                F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("n_incomplete_rows"),
            )
            good = (F.col("n_duplicate_rows") == 0) & (F.col("n_incomplete_rows") == 0)
            row = row.select(F.lit(name).alias("family"), F.when(good, "ok").otherwise("review").alias("status"), "n_keys", "n_duplicate_rows", "n_incomplete_rows")
        out = row if out is None else out.union(row)
    return out


def key_candidates(df: DataFrame, base: Sequence[str], extra: Sequence[str], most_extra: int = 2) -> DataFrame:
    """Sets of key columns: the base and up to ``most_extra`` more; unique ones first, then short ones.

    All sets are counted in one pass by grouping sets.
    """
    extra = [c for c in extra if c in df.columns and c not in base]
    tries = [tuple(base) + pick for n in range(most_extra + 1) for pick in combinations(extra, n)]
    columns = list(dict.fromkeys(c for t in tries for c in t))
    grouped = df.groupingSets([[F.col(c) for c in t] for t in tries], *[F.col(c) for c in columns])
    counted = grouped.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    ids = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in t): ",".join(t) for t in tries}
    names = df.sparkSession.createDataFrame([(k, v, v.count(",") + 1) for k, v in ids.items()], "gid bigint, key_columns string, n_columns int")
    many = F.when(F.col("n") > 1, F.col("n"))
    report = counted.groupBy("gid").agg(F.coalesce(F.sum(many), F.lit(0)).alias("n_duplicate_rows"), F.count(many).alias("n_duplicate_keys"))
    report = report.join(F.broadcast(names), "gid").withColumn("is_unique", F.col("n_duplicate_rows") == 0)
    return report.select("key_columns", "n_columns", "n_duplicate_rows", "n_duplicate_keys", "is_unique")


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str = "right", policy: str = "error") -> DataFrame:
    """LEFT join of at most one row of ``right`` a key; NULL keys match.

    Columns of ``right`` that ``left`` has already come as ``label__column``. Spark
    picks the join: small metadata is broadcast by its measured size, no hint is set.
    """
    missing = [k for k in keys if k not in left.columns or k not in right.columns]
    if missing:
        raise KeyProblem(f"no key columns {missing}")
    right = collapse_duplicates(right, keys, policy)
    new = {c: (f"{label}__{c}" if c in left.columns else c) for c in right.columns if c not in keys}
    side = right.select(*keys, *[F.col(c).alias(n) for c, n in new.items()])
    joined = left.alias("l").join(side.alias("r"), same_keys(keys), "left")
    return joined.select("l.*", *[F.col(f"r.`{n}`") for n in new.values()])


def unmatched_count(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of ``left`` have no row in ``right``."""
    alone = left.alias("l").join(right.select(*keys).distinct().alias("r"), same_keys(keys), "left_anti")
    return alone.agg(F.count(F.lit(1)).alias("n_unmatched"))


#: What tells rows of combined profile tables apart, if the columns are there.
COMBINED_KEYS = ("Metadata_Profile_Source", "Metadata_Plate", "ImageNumber", "Metadata_Well", "Metadata_Site")


def combined_keys(columns: Sequence[Sequence[str]], requested: Sequence[str] | None = None) -> list[str]:
    """The requested keys, or COMBINED_KEYS, that any of the tables has; each once."""
    there = {c for one in columns for c in one}
    return [k for k in dict.fromkeys(COMBINED_KEYS if requested is None else requested) if k in there]


def choose_merge_keys(left: Sequence[str], right: Sequence[str], requested: Sequence[str] | None = None, well_only: bool = False) -> list[str]:
    """The requested keys, else source plate and well, else plate and well, else (if allowed) the well."""
    both = set(left) & set(right)
    if requested:
        if not set(requested) <= both:
            raise KeyProblem(f"keys {sorted(set(requested) - both)} are not in both tables")
        return list(requested)
    for keys in (["Metadata_Source_Plate", "Metadata_Source_Well"], ["Metadata_Plate", "Metadata_Well"]):
        if set(keys) <= both:
            return keys
    if well_only and "Metadata_Well" in both:
        return ["Metadata_Well"]
    raise KeyProblem("the tables share no plate and well columns")


def choose_image_keys(left: DataFrame, right_columns: Sequence[str], requested: Sequence[str] | None = None) -> list[str]:
    """Keys between images and objects; the bare image number only if it is unique among the images."""
    both = set(left.columns) & set(right_columns)
    if requested:
        if "ImageNumber" not in requested or not set(requested) <= both:
            raise KeyProblem("requested keys must stand in both tables and hold ImageNumber")
        return list(requested)
    for keys in (["Metadata_Plate", "Metadata_Well", "ImageNumber"], ["Metadata_Plate", "ImageNumber"]):
        if set(keys) <= both:
            return keys
    if "ImageNumber" not in both:
        raise KeyProblem("ImageNumber is missing")
    if not key_counts(left, ["ImageNumber"]).where("n_rows > 1").isEmpty():
        raise KeyProblem("ImageNumber repeats among the images, and the objects have no plate")
    return ["ImageNumber"]


def key_mapping(images: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, its distinct values of ``columns``, and n_values: more than one is ambiguous."""
    distinct = images.select(key, *columns).distinct()
    return distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"), *[F.min(c).alias(c) for c in columns])


def propagate_keys(objects: DataFrame, images: DataFrame, key: str, columns: Sequence[str], explicit: bool = False) -> tuple[DataFrame, str]:
    """Stamps plate and well of the images onto objects, if each key has one value.

    Returns the objects and a status: not_needed, missing_key, ambiguous or propagated.
    An ambiguous mapping raises where the columns were asked for explicitly.
    """
    columns = [c for c in columns if c in images.columns and c not in objects.columns and not c.startswith("Metadata_Source_")]
    if not columns:
        return objects, "not_needed"
    if key not in objects.columns or key not in images.columns:
        return objects, "missing_key"
    mapping = key_mapping(images, key, columns)
    if not mapping.where("n_values > 1").isEmpty():
        if explicit:
            raise KeyProblem(f"{key} has several values of {columns}")
        return objects, "ambiguous"
    return join_checked(objects, mapping.drop("n_values"), [key]), "propagated"


def combine_tables(tables: dict[str, DataFrame], features: dict[str, Sequence[str]], how: str = "union") -> DataFrame:
    """UNION ALL by name, with the table's name in Metadata_Profile_Source.

    how: all features (missing ones as NULL), or only those that all tables have.
    Other columns are always united.
    """
    if how not in ("union", "intersection"):
        raise ValueError("how must be union or intersection")
    common = set.intersection(*[set(f) for f in features.values()])
    out = None
    for label, df in tables.items():
        if how == "intersection":
            df = df.drop(*[f for f in features[label] if f not in common])
        if "Metadata_Profile_Source" in df.columns:
            df = df.withColumnRenamed("Metadata_Profile_Source", "Metadata_Profile_Source__input")
        df = df.withColumn("Metadata_Profile_Source", F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def split_by_group(df: DataFrame, group: str, seed: int = 42, names: tuple[str, str] = ("split_a", "split_b")) -> DataFrame:
    """Adds ``split``; a group is never divided, and the halves have as many groups, within one.

    Groups are ordered by a hash with the seed; the table of groups is numbered, not the rows.
    """
    from pyspark.sql import Window

    groups = df.select(group).distinct()
    order = Window.orderBy(F.xxhash64(F.lit(seed), F.col(group)), F.col(group))
    halves = groups.withColumn("split", F.when(F.ntile(2).over(order) == 1, names[0]).otherwise(names[1]))
    return df.alias("l").join(halves.alias("r"), same_keys([group]), "left").select("l.*", "r.split")

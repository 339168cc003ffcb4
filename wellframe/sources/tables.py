"""Reading, writing and finding tables; roles of files and columns by their names."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".parquet", ".csv", ".csv.gz", ".tsv", ".tsv.gz", ".txt")

# Parts of names by which columns are known; they must be these for equal results.
METADATA_TOKENS = (
    "metadata", "plate", "well", "site", "field", "compound", "treatment", "dose", "concentration", "donor", "batch", "replicate",
    "moa", "mechanism", "class", "label", "library", "barcode", "sourcew", "cpd_id", "cpd_type",
)
FEATURE_TOKENS = ("areashape", "children", "correlation", "granularity", "intensity", "location", "neighbors", "radialdistribution", "texture", "zernike")
EXCLUDED_PREFIXES = (
    "executiontime", "filename", "pathname", "url", "md5digest", "height", "width", "channel", "group_index", "group_length", "group_number",
    "imageid", "imagename", "imagenumber", "imageseries", "objectnumber", "number_object_number", "parent_", "mean_parent_",
)
COUNT_TOKENS = ("count_", "mean_count_", "children_", "mean_children_")
#: Canonical columns and the names that stand for them, in lower case; case does not matter.
ALIASES = {
    "Metadata_Plate": (
        "metadata_plate", "plate_metadata", "plate", "plate_id", "plateid", "image_metadata_plate", "metadata_plateid", "assay_plate_barcode",
        "assayplatebarcode", "destination_plate_barcode", "destinationplatebarcode",
    ),
    "Metadata_Well": (
        "metadata_well", "well_metadata", "well", "well_id", "image_metadata_well", "assay_well", "assaywell", "metadata_assay_well",
        "destinationwell", "destination_well", "destination well", "well_position",
    ),
    "Metadata_Source_Plate": ("metadata_source_plate", "source_plate_barcode", "source plate barcode", "sourceplatebarcode", "spb"),
    "Metadata_Source_Well": ("metadata_source_well", "source_well", "source well", "sourcewell", "sw", "sw2"),
    "Metadata_Row": ("metadata_row", "row_metadata", "row", "plate_row", "image_metadata_row"),
    "Metadata_Column": ("metadata_column", "column_metadata", "column", "plate_column", "image_metadata_column"),
    "Metadata_Site": ("metadata_site", "field_metadata", "site", "image_metadata_site", "imagenumber_metadata_site", "field"),
    "Metadata_Compound": (
        "metadata_compound", "compound", "name", "cpd_id", "compound_id", "compound_number", "compound_name", "pert_iname", "treatment",
    ),
    "Metadata_MOA": ("metadata_moa", "moa", "mechanism", "cpd_type", "class", "mode_of_action", "modeofaction"),
    "Metadata_Dose": ("metadata_dose", "dose", "destination concentration", "destination_concentration", "concentration", "pert_dose"),
    "Metadata_Dose_Unit": (
        "metadata_dose_unit", "destination concentration units", "destination_concentration_units", "dose_unit", "concentration_units",
    ),
    "Metadata_Batch": ("metadata_batch", "batch", "library", "experiment"),
}


#: Older names of canonical columns, added beside them.
LEGACY = {"Metadata_Plate": "Plate_Metadata", "Metadata_Well": "Well_Metadata", "Metadata_Compound": "cpd_id", "Metadata_MOA": "cpd_type", "Metadata_Batch": "Library"}


def is_sidecar(path: str) -> bool:
    """Hidden files, resource forks and editors' lock files, in any folder of the path."""
    return any(p.startswith((".", "~$")) and p not in (".", "..") for p in Path(path).parts)


def discover(folder: str, recursive: bool = False) -> list[str]:
    """Paths of tables in a folder, sorted; a folder that doesn't exist raises."""
    root = Path(folder)
    if not root.is_dir():
        raise FileNotFoundError(folder)
    found = root.rglob("*") if recursive else root.iterdir()
    return sorted(str(p) for p in found if p.name.lower().endswith(SUFFIXES) and not is_sidecar(str(p.relative_to(root))))


def clean_name(name: str) -> str:
    return re.sub(r"\s+", " ", name.replace("﻿", "").strip())


def clean_names(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Names without byte-order marks and spare blanks, repeated ones numbered; and (old, new) pairs."""
    seen: dict[str, int] = {}
    new = []
    for c in df.columns:
        name = clean_name(c)
        seen[name] = seen.get(name, 0) + 1
        new.append(name if seen[name] == 1 else f"{name}__duplicate_{seen[name] - 1}")
    return df.toDF(*new), list(zip(df.columns, new))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet, CSV or TSV table (also gzipped) by its suffix, through Spark's readers, so from any store.

    Give ``schema`` for text tables of size: else their types are inferred by a pass
    over the data. Excel files are not read; convert them first.
    """
    low = path.lower()
    if low.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if not low.endswith(SUFFIXES):
        raise ValueError(f"no reader for {path}; there are readers for {SUFFIXES}")
    sep = "," if re.search(r"\.csv(\.gz)?$", low) else "\t"
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return clean_names(reader.csv(path))[0]


def read_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names only: the Parquet footer, or the first line."""
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path).columns
    sep = "," if re.search(r"\.csv(\.gz)?$", path.lower()) else "\t"
    return [clean_name(c) for c in spark.read.option("header", True).option("sep", sep).csv(path).columns]


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """Parquet, or TSV (gzipped for .gz) with a header; ``single`` for one file, for small tables only."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    low = path.lower()
    if low.endswith(".parquet"):
        out.parquet(path)
    elif re.search(r"\.tsv(\.gz)?$", low):
        out.option("header", True).option("sep", "\t").option("compression", "gzip" if low.endswith(".gz") else "none").csv(path)
    else:
        raise ValueError(f"no writer for {path}: use .parquet, .tsv or .tsv.gz")


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}.parquet")


def table_role(name: str, columns: Sequence[str]) -> tuple[str, str]:
    """(role, reason): object, image, profile, metadata or unknown, from a file's header and name."""
    low = {c.lower() for c in columns}
    has = lambda *keys: any(any(k in c for k in keys) for c in low)
    features = any(t in c for c in low for t in FEATURE_TOKENS)
    if "imagenumber" in low and low & {"objectnumber", "number_object_number"}:
        return "object", "has ImageNumber and ObjectNumber"
    if "imagenumber" in low:
        if any("__" in c for c in low) and features:
            return "profile", "has ImageNumber and aggregated features"
        return "image", "has ImageNumber without ObjectNumber"
    if has("plate") and has("well"):
        if features:
            return "profile", "has plate, well and features"
        if has("compound", "cpd", "moa", "treatment") or re.search(r"meta|map|layout|annot", name, re.I):
            return "metadata", "has plate and well, and compounds or a telling name"
    if features:
        return "profile", "has feature columns"
    return "unknown", "no rule applies"


def inspect_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, role, reason, n_columns of each table; unreadable ones get the role unreadable and the error's text."""
    rows = []
    for path in discover(folder, recursive):
        try:
            columns = read_columns(spark, path)
            rows.append((path, *table_role(Path(path).name, columns), len(columns)))
        except Exception as e:  # any reader's error is a finding here
            rows.append((path, "unreadable", str(e).splitlines()[0][:300], 0))
    return spark.createDataFrame(rows, "path string, role string, reason string, n_columns int")


def is_metadata_name(name: str) -> bool:
    return any(t in name.lower() for t in METADATA_TOKENS)


def is_feature_name(name: str) -> bool:
    return any(t in name.lower() for t in FEATURE_TOKENS)


def exclusion(name: str) -> str | None:
    """Why a numeric column is provenance or a count rather than a feature; a table's prefix (``cells__``) aside."""
    low = name.lower()
    if low.startswith(EXCLUDED_PREFIXES) or low.split("__")[-1].startswith(EXCLUDED_PREFIXES):
        return "excluded_prefix"
    return "count" if any(t in low for t in COUNT_TOKENS) else None


def column_roles(df: DataFrame, metadata: Sequence[str] | None = None, features: Sequence[str] | None = None) -> list[tuple[str, str]]:
    """(column, role) for each column; given lists override the rules. Booleans are no features."""
    numeric = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")}
    meta = set(metadata) if metadata is not None else {c for c in df.columns if c not in numeric or is_metadata_name(c)}
    able = [c for c in df.columns if c in numeric and c not in meta and exclusion(c) is None]
    chosen = list(features) if features is not None else ([c for c in able if is_feature_name(c)] or able)
    out = []
    for c in df.columns:
        if c in chosen:
            role = "feature"
        elif c in meta:
            role = "metadata"
        elif c in numeric:
            role = "excluded_numeric" if exclusion(c) else "numeric_not_selected"
        else:
            role = "non_numeric_not_selected"
        out.append((c, role))
    return out


def feature_columns(df: DataFrame, metadata: Sequence[str] | None = None, features: Sequence[str] | None = None) -> list[str]:
    return [c for c, role in column_roles(df, metadata, features) if role == "feature"]


def standardise(df: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES, overwrite: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Adds canonical Metadata_ columns from the first alias that is there; wells get their normal form.

    Returns also (canonical, taken from). Columns already there stay unless ``overwrite``.
    """
    from wellframe.functions.text import canonical_column, canonical_row, canonical_well, derived_well

    low = {c.lower(): c for c in reversed(df.columns)}
    taken = []
    for canonical, names in aliases.items():
        if canonical in df.columns and not overwrite:
            continue
        source = next((low[n] for n in names if n in low), None)
        if source:
            df = df.withColumn(canonical, F.col(f"`{source}`"))
            taken.append((canonical, source))
    shaped = {"Metadata_Well": canonical_well, "Metadata_Source_Well": canonical_well, "Metadata_Row": canonical_row, "Metadata_Column": canonical_column}
    df = df.withColumns({c: make(F.col(c)) for c, make in shaped.items() if c in df.columns})
    if {"Metadata_Row", "Metadata_Column"} <= set(df.columns):
        well = F.col("Metadata_Well") if "Metadata_Well" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("Metadata_Well", derived_well(well, F.col("Metadata_Row"), F.col("Metadata_Column")))
    return df, taken


def explicit_keys(df: DataFrame, plate: str | None = None, well: str | None = None, source_plate: str | None = None, source_well: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with the named columns as assay and source keys; target_column, explicit_source_column, action and n_non_missing).

    Names are found whatever their case, and an unknown one raises. What a key held
    before stays as <key>__before_explicit_override, what it is taken from as
    <key>__raw, where there are no such columns yet. Source keys are never assay keys.
    """
    wanted = {"Metadata_Plate": plate, "Metadata_Well": well, "Metadata_Source_Plate": source_plate, "Metadata_Source_Well": source_well}
    low = {c.lower(): c for c in reversed(df.columns)}
    before, found, made = df, {}, {}
    for target, name in wanted.items():
        name = (name or "").strip()
        if not name:
            continue
        if name.lower() not in low:
            raise ValueError(f"there is no column {name!r}; there are {df.columns}")
        found[target] = low[name.lower()]
        for kept, source in ((f"{target}__before_explicit_override", target), (f"{target}__raw", found[target])):
            if source in df.columns and kept not in df.columns:
                made[kept] = F.col(f"`{source}`")
        made[target] = F.col(f"`{found[target]}`")
    df = df.withColumns(made)  # all at once, so that a key taken from another key gets what that held
    counts = [F.count(F.col(f"`{c}`")) for c in found.values()]
    rows = [F.struct(F.lit(t).alias("target_column"), F.lit(found.get(t, "")).alias("explicit_source_column"), F.lit("set_from_explicit_column" if t in found else "not_requested").alias("action"),
                     (F.col("c")[list(found).index(t)] if t in found else F.lit(0)).cast("bigint").alias("n_non_missing")) for t in wanted]
    return df, before.agg(F.array(*counts, F.lit(0).cast("bigint")).alias("c")).select(F.inline(F.array(*rows)))


def source_like_keys(taken: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of (canonical, taken from) the assay keys that were taken from columns of a source plate or well."""
    return [(k, c) for k, c in taken if k in ("Metadata_Plate", "Metadata_Well") and re.search(r"source|^spb$|^sw2?$", c, re.I)]


def with_legacy_columns(df: DataFrame) -> DataFrame:
    """Adds the older names of canonical columns, where there are none yet."""
    low = {c.lower() for c in df.columns}
    return df.withColumns({new: F.col(old) for old, new in LEGACY.items() if old in df.columns and new.lower() not in low})


def sequential_index_columns(df: DataFrame) -> list[str]:
    """Columns named Unnamed... that hold 0 to n-1, each once: the leftovers of a row index."""
    found = []
    for c in [c for c in df.columns if c.lower().startswith("unnamed")]:
        v = F.col(f"`{c}`").try_cast("bigint")
        r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(v).alias("d"), F.min(v).alias("low"), F.max(v).alias("high")).first()
        if r["n"] and r["d"] == r["n"] and r["low"] == 0 and r["high"] == r["n"] - 1:
            found.append(c)
    return found


def parse_list(value: str | Sequence[str] | None) -> list[str] | None:
    if value is None:
        return None
    parts = re.split(r"[,;\t\n]", value) if isinstance(value, str) else value
    return [p.strip() for p in parts if p.strip()] or None


def read_list_file(path: str) -> list[str]:
    lines = (x.strip() for x in Path(path).read_text(encoding="utf-8-sig").splitlines())
    return [x for x in lines if x and not x.startswith("#")]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """dataset and path of each dataset; ``name`` and ``file`` are accepted as names of these columns."""
    df = read_table(spark, path)
    low = {c.lower(): c for c in df.columns}
    pick = lambda *names: next((low[n] for n in names if n in low), None)
    dataset, file = pick("dataset", "name"), pick("path", "file")
    if not dataset or not file:
        raise ValueError("a manifest needs the columns dataset and path")
    return df.select(F.trim(F.col(dataset).cast("string")).alias("dataset"), F.trim(F.col(file).cast("string")).alias("path"))


def load_datasets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All datasets in one table, with Dataset."""
    out = None
    for name, path in paths.items():
        df = standardise(read_table(spark, path))[0].withColumn("Dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def neighbours_from_wide(df: DataFrame, query: str, prefix: str = "NN") -> DataFrame:
    """query_id, neighbour_id and rank from columns NN1, NN2, ...; the query itself left out."""
    named = sorted((int(m[1]), c) for c in df.columns if (m := re.fullmatch(rf"{prefix}(\d+)", c)))
    long = df.select(query, *[F.col(c).cast("string").alias(str(k)) for k, c in named]).unpivot([query], [str(k) for k, _ in named], "rank", "neighbour_id")
    return long.where(F.col("neighbour_id").isNotNull() & (F.col(query).cast("string") != F.col("neighbour_id"))).select(F.col(query).alias("query_id"), "neighbour_id", F.col("rank").cast("int").alias("rank"))


def html_table(df: DataFrame, most: int = 20) -> str:
    """The first rows as escaped HTML."""
    rows = df.limit(most).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def html_report(title: str, tables: dict[str, DataFrame], narrative: str = "", warnings: Sequence[str] = (), most: int = 50) -> str:
    """A page with a list of contents, warnings and a preview of each table."""
    links = "".join(f'<li><a href="#{html.escape(n)}">{html.escape(n)}</a></li>' for n in tables)
    notes = "".join(f"<p class='warning'>{html.escape(w)}</p>" for w in warnings)
    blocks = "".join(f'<h2 id="{html.escape(n)}">{html.escape(n)}</h2>{html_table(t, most)}' for n, t in tables.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(narrative)}</p>{notes}<ul>{links}</ul>{blocks}</body></html>"


def save_config(config: dict, path: str) -> None:
    Path(path).write_text(json.dumps(config, indent=2, sort_keys=True), encoding="utf-8")


def load_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


#: Parts of a file's name that tell its compartment, the first that fits (fixed values).
COMPARTMENTS = {"nuclei": "Nuclei", "cytoplasm": "Cytoplasm", "mitochondria": "Mitochondria", "acrosome": "Acrosome", "image": "Image", "cell": "Cell"}


def compartment_of(file_name: str) -> str | None:
    """The compartment that a file's name tells, regardless of case."""
    return next((c for token, c in COMPARTMENTS.items() if token in file_name.lower()), None)


def compartment_files(folder: str) -> dict[str, list[str]]:
    """Paths of a folder's object tables by compartment, subfolders included; image tables and unknown ones are left out."""
    out: dict[str, list[str]] = {}
    for path in discover(folder, recursive=True):
        compartment = compartment_of(Path(path).name)
        if compartment not in (None, "Image"):
            out.setdefault(compartment, []).append(path)
    return dict(sorted(out.items()))

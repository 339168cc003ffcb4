"""Column expressions on names, wells and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_null(c: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def label_text(c: Column, missing: str = "nan") -> Column:
    """Labels as text, with a real group for the missing ones."""
    return F.coalesce(c.cast("string"), F.lit(missing))


def normal_id(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def normal_label(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def canonical_well(c: Column) -> Column:
    """One letter and up to two digits (zeros before them aside) become A01; other text is trimmed."""
    t = F.trim(c.cast("string"))
    well = F.concat(F.upper(F.substring(t, 1, 1)), F.lpad(F.regexp_extract(t, r"^[A-Za-z]0*([0-9]{1,2})$", 1), 2, "0"))
    return F.when(t.rlike(r"^[A-Za-z]0*[0-9]{1,2}$"), well).otherwise(t)


def canonical_row(c: Column) -> Column:
    """One letter in upper case; other text is trimmed."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike("^[A-Za-z]$"), F.upper(t)).otherwise(t)


def canonical_column(c: Column) -> Column:
    """Up to three digits as a whole number, else NULL."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(t.rlike("^[0-9]{1,3}$"), t.try_cast("int"))


def plate_well(c: Column) -> Column:
    """The layout rule: any letters and digits, the number padded to two; blank becomes NULL."""
    t = text_or_null(c)
    letters, digits = F.regexp_extract(t, r"^([A-Za-z]+)0*([0-9]+)$", 1), F.regexp_extract(t, r"^([A-Za-z]+)0*([0-9]+)$", 2)
    padded = F.concat(F.upper(letters), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    return F.when(t.rlike(r"^[A-Za-z]+0*[0-9]+$"), padded).otherwise(F.upper(t))


def plate_row(well: Column) -> Column:
    r = F.regexp_extract(plate_well(well), r"^([A-Z]+)[0-9]+$", 1)
    return F.when(r != "", r)


def plate_column(well: Column) -> Column:
    return F.regexp_extract(plate_well(well), r"^[A-Z]+([0-9]+)$", 1).try_cast("int")


def derived_well(well: Column, row: Column, column: Column) -> Column:
    """The well, or where it is missing, row letter and padded column."""
    made = F.concat(canonical_row(row), F.lpad(canonical_column(column).cast("string"), 2, "0"))
    return F.coalesce(text_or_null(well), made)


def well_of_index(index: Column, rows: int = 16, columns: int = 24) -> Column:
    """The well of a running index on a plate, row by row: A01, A02, ... then again from A01."""
    at = F.pmod(index, F.lit(rows * columns))
    letter = F.char((F.floor(at / columns) + 65).cast("int"))
    return F.concat(letter, F.lpad((F.pmod(at, F.lit(columns)) + 1).cast("string"), 2, "0"))


def file_label(c: Column) -> Column:
    """A file's name without folder and suffix, with underscores for all but letters and digits."""
    stem = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?i)\.(csv|tsv|txt|parquet|xlsx|xls)(\.gz)?$", "")
    return F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def family_of(feature: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """The first family one of whose tokens stands in the name, regardless of case; else Other."""
    low = F.lower(feature)
    out = None
    for family, tokens in families.items():
        hit = F.lit(False)
        for token in tokens:
            hit = hit | low.contains(token.lower())
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return F.lit("Other") if out is None else out.otherwise("Other")

"""Parsing of ids, demographics, paths and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_years(age: Column) -> Column:
    """'073Y' -> 73.0; missing unless it holds a 'Y' and the rest is a number."""
    rest = F.trim(F.replace(age, F.lit("Y"), F.lit("")))
    return F.when(age.contains("Y"), rest.try_cast("double"))


def sex_code(sex: Column) -> Column:
    """M is 1, F is 0, all else is missing."""
    return F.when(sex == "M", 1).when(sex == "F", 0)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*(?:\.gz)?)?$", 1)


def file_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def strip_tissue_prefix(name: Column) -> Column:
    """The name without a leading c1, c2 or c3."""
    return F.regexp_replace(name, "^c[123]", "")


def key_value(line: Column) -> tuple[Column, Column]:
    """'Key = a = b' -> upper-case key and the rest, both trimmed."""
    parts = F.split(line, "=", 2)
    return F.upper(F.trim(parts[0])), F.trim(parts[1])


def subject_names(df, name: str = "subject_id", not_subjects: tuple[str, ...] = ("overviews", "results")):
    """Directory names that are subjects: no dot names, none of the listed."""
    return df.where(~F.col(name).startswith(".") & ~F.col(name).isin(*not_subjects))

"""Dataset identity from folder and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Naming patterns of dataset folders and daily files
FOLDER_PATTERN = r"^([A-Za-z][A-Za-z0-9]{3})(?:[\s_\-.]+(.*))?$"
FILE_PATTERN = r"^([A-Za-z][A-Za-z0-9]{3})[_\-]?(?:19|20)\d{6}"


def airport_code(folder: Column, file_name: Column | None = None) -> Column:
    """Upper-case airport code from the folder name, else from a daily file name."""
    code = F.regexp_extract(folder, FOLDER_PATTERN, 1)
    if file_name is not None:
        code = F.when(code != "", code).otherwise(F.regexp_extract(file_name, FILE_PATTERN, 1))
    return F.upper(F.when(code != "", code))


def dataset_label(folder: Column) -> Column:
    """Lower-case label after the code, 'all' when nothing is left."""
    matched = F.regexp_like(folder, F.lit(FOLDER_PATTERN))
    rest = F.when(matched, F.regexp_extract(folder, FOLDER_PATTERN, 2)).otherwise(folder)
    flat = F.regexp_replace(F.regexp_replace(F.lower(rest), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(flat == "", "all").otherwise(flat)


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))

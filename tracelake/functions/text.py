"""Label and path functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_label(value: Column) -> Column:
    """``0x`` and lower-case hex without padding; zero reads ``0x0``."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def base_name(path: Column) -> Column:
    """Last component of a path written with either slash."""
    return F.regexp_extract(path, r"[^\\/]+$", 0)


def is_exe(path: Column) -> Column:
    return F.lower(path).endswith(".exe")


def is_full_path(path: Column) -> Column:
    return path.contains("\\")

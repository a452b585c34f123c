"""Column functions on text and paths, with Unicode-aware definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]+"
WHITE = r"(?U)^\s+|\s+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: str | Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(col(c)), NOT_WORD), lambda w: w != "")


def strip(c: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(c), WHITE, "")


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: str | Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: str | Column) -> Column:
    """The lower-cased last extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1))

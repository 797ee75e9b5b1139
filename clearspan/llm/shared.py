"""The shared folder's tables, and a few column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import forget, new_path, shared_dir, stored

#: The six ASCII white-space characters, space first.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java character class.
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until it is none of the columns (upper and lower case alike)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def whole(column: Column) -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def words_of(column: Column) -> Column:
    """Maximal runs of anything but ASCII white space, in order. Splits at one character: several times as fast as at a pattern."""
    body = whole(column)
    for blank in BLANKS[1:]:
        body = F.replace(body, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(body, " "), "")


def long_table(values: list[float]) -> Column:
    """A constant array of doubles; written as one string, so that the plan stays small to build."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")

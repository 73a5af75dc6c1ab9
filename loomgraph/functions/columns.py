"""Column expressions over the node and edge schema (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRUCTURAL = ("imports", "calls", "inherits", "defines")
DATA = ("reads", "writes", "shares")
TEMPORAL = ("triggers", "awaits", "sequences")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def edge_kind(kind: Column | str = "kind") -> Column:
    """An edge kind as compared: trimmed, in lower case."""
    return F.lower(F.trim(_c(kind)))


def family(kind: Column | str = "kind") -> Column:
    """structural, data or temporal; null for an unknown kind."""
    k = edge_kind(kind)
    return F.when(k.isin(*STRUCTURAL), "structural").when(k.isin(*DATA), "data").when(k.isin(*TEMPORAL), "temporal")


def location_file(location: Column | str = "location") -> Column:
    """The path of a location: no line, no column, ``/`` for a backslash."""
    return F.regexp_replace(F.translate(_c(location), "\\", "/"), r"(:[0-9]+){1,2}$", "")


def location_line(location: Column | str = "location") -> Column:
    """The line of a location, null where it has none."""
    return F.regexp_extract(_c(location), r"^.*?:([0-9]+)(:[0-9]+)?$", 1).try_cast("int")


def short_name(name: Column | str = "name") -> Column:
    """What follows the last dot."""
    return F.substring_index(_c(name), ".", -1)


def edge_key(source: str = "source", target: str = "target", kind: str = "kind") -> Column:
    """The identity of an edge in a stored graph."""
    return F.concat_ws("::", F.col(source), F.col(target), edge_kind(kind))


def tagged(value: Column | str) -> Column:
    """A string in which null differs from every value."""
    return F.coalesce(F.concat(F.lit("v"), _c(value).cast("string")), F.lit("n"))


def row_hash(*columns: Column | str) -> Column:
    """16 bytes over the columns in order; null is a value of its own.

    Each value is preceded by its length, so no two rows of values share a text.
    """
    parts = []
    for c in columns:
        v = tagged(c)
        parts += [F.length(v).cast("string"), F.lit(":"), v]
    return F.unhex(F.md5(F.concat(*parts)))

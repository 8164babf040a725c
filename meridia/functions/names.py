"""Names for an operator's own columns beside whatever columns a table has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """Each name, with underscores before it until no column has it; Spark's column names
    don't depend on case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """The name as an identifier, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def row_order(df: DataFrame) -> Column:
    """A hash of the whole row: with it ties between rows that differ are decided alike in
    every run. Types that can't be hashed are taken as JSON text."""
    columns = [df[quoted(c)] for c in df.columns]
    if any(t in df.schema.simpleString() for t in ("map<", "variant")):
        return F.xxhash64(F.to_json(F.struct(*columns)))
    return F.xxhash64(*columns)

"""The caller's columns, kept apart from an operator's own, whatever they are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame, *without: str) -> Column:
    """All columns of docs but some as one struct, so that their names meet no others; taken apart again by "row.*"."""
    return F.struct(*(quoted(c).alias(c) for c in docs.columns if c not in without)).alias("row")


def unlike(docs: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until docs has no such column."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out

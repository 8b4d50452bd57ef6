"""Columns of any name beside an operator's own working columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def col(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` but some as one struct, inside which no name can clash."""
    kept = [col(c).alias(c) for c in df.columns if c not in leave_out]
    return F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("_none"))


def unpacked(struct: str, names: list[str]) -> list[Column]:
    """The named fields of a packed struct as columns."""
    return [F.col(struct).getField(name).alias(name) for name in names]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Names for columns that an operator adds for its own use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(stem: str, *tables: DataFrame) -> str:
    """A name, made from ``stem``, that no column of the tables has; Spark takes names of either case for one."""
    taken = {c.lower() for df in tables for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem

"""Column names that the input does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores behind it while ``docs`` has a column of that name in any case."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted

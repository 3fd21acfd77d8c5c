"""Union of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_same(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, matched by name.

    For files, hand all paths to one read instead: that is one scan rather than many.
    """
    return reduce(DataFrame.unionByName, frames)


def union_outer(frames: Sequence[DataFrame], sort_columns: bool = False) -> DataFrame:
    """All rows of tables whose columns differ; what a table lacks is null."""
    result = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return result.select(*sorted(result.columns)) if sort_columns else result

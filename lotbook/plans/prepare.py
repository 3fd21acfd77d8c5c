"""Raw batches to the table that analysis and models read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lotbook.operators.clean import drop_incomplete, drop_repeats, with_age
from lotbook.operators.combine import union_outer
from lotbook.operators.features import min_max_scale
from lotbook.session import staged


def prepare(batches: Sequence[DataFrame], ref_year: int = 2020, scale: Sequence[str] = ("mileage", "age")) -> DataFrame:
    """Union, drop incomplete rows and repeats, age instead of year, scale.

    Incomplete rows go first, so they are never shuffled. The distinct rows are written once, because
    scaling reads them twice: for the ranges (two columns of a columnar table) and for the rows.
    """
    distinct = drop_repeats(drop_incomplete(union_outer(batches)))
    return min_max_scale(staged(with_age(distinct, ref_year), "prepared"), scale)

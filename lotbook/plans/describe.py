"""The tables behind the charts of a first look at the clean listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from lotbook.operators import stats as A
from lotbook.operators.clean import one_of, with_segment

# How many values each frequency table shows.
FREQUENT = {"make": 10, "model": 10, "color": 10, "body_style": 12}


def overview(
    table: DataFrame,
    makes: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    segments: Mapping[str, Sequence[str]],
    label: str = "price",
    bins: int = 50,
) -> dict[str, DataFrame]:
    """Frequencies, counts, moments, histograms, curves and t-tests for the chosen makes.

    ``table`` should be a written table: every entry is a scan of the few columns it needs.
    """
    result = {f"top_{column}": A.value_counts(table, column, k) for column, k in FREQUENT.items()}
    result["rows"] = A.row_counts(table, "make", makes)
    result["describe"] = A.describe(one_of(table, "make", makes), [label], by=["make"])
    result["scatter"] = A.scatter_bins(table, "make", label, bins, makes)
    for a, b in pairs:
        result[f"histogram_{a}_{b}"] = A.histogram(table, label, bins, "make", [a, b])
    result["t_tests"] = A.with_p_values(A.ttest_pairs(table, label, "make", pairs))
    grouped = with_segment(table, segments).where("segment is not null")
    result["segments"] = A.moments(grouped, label, ["segment"])
    result["segment_density"] = A.density_histogram(grouped, label, 60, "segment")
    result["segment_curve"] = A.normal_curve(grouped, label, 60, "segment", common=True)
    return result

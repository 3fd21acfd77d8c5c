"""Regression metrics against a constant baseline."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.operators.quantiles import exact_median


def baseline_value(df: DataFrame, label: str, baseline: str = "median") -> Column:
    """The constant that the baseline model predicts: the median or the mean of the label."""
    if baseline == "median":
        return exact_median(df, label).select("median").scalar()
    if baseline == "mean":
        return df.agg(F.avg(label)).scalar()
    raise ValueError("baseline is 'median' or 'mean'")


def constant_predictions(df: DataFrame, label: str, baseline: str = "median", name: str = "prediction") -> DataFrame:
    """The baseline as a model: every row gets the same prediction."""
    return df.withColumn(name, baseline_value(df, label, baseline))


def evaluate(predictions: DataFrame, label: str = "price", prediction: str = "prediction",
             baseline: str | float | None = "median") -> DataFrame:
    """One row: n, mse, rmse, r2, baseline, base_rmse, rmse_ratio.

    One aggregate over the predictions, besides the passes that find the median: the spread of the label around any
    constant follows from its variance and mean. A number as baseline is used as it is.
    """
    constant = baseline_value(predictions, label, baseline) if isinstance(baseline, str) else F.lit(baseline).cast("double")
    y, error = F.col(label).cast("double"), F.col(label) - F.col(prediction)
    sums = predictions.agg(
        F.count(label).alias("n"),
        F.avg(F.pow(error, F.lit(2))).alias("mse"),
        F.avg(y).alias("_mean"),
        F.var_pop(y).alias("_var"),
    ).withColumn("baseline", constant)
    base_rmse = F.sqrt(F.col("_var") + F.pow(F.col("_mean") - F.col("baseline"), F.lit(2)))
    return sums.select(
        "n",
        "mse",
        F.sqrt("mse").alias("rmse"),
        (1 - F.col("mse") / F.when(F.col("_var") > 0, F.col("_var"))).alias("r2"),
        "baseline",
        base_rmse.alias("base_rmse"),
        (F.sqrt("mse") / F.when(base_rmse > 0, base_rmse)).alias("rmse_ratio"),
    )


def r2_score(predictions: DataFrame, label: str = "price", prediction: str = "prediction") -> DataFrame:
    return evaluate(predictions, label, prediction, "mean").select("r2")


def leaderboard(predictions: Mapping[str, DataFrame], label: str = "price", baseline: str = "median",
                rows: DataFrame | None = None) -> DataFrame:
    """One ``evaluate`` row per model, best first.

    ``rows``: what all models predict, if it is the same for all; the baseline is then worked out once.
    """
    if rows is not None:
        baseline = rows.sparkSession.range(1).select(baseline_value(rows, label, baseline)).first()[0]
    rows = [
        evaluate(df, label, baseline=baseline).select(F.lit(name).alias("model"), "*")
        for name, df in predictions.items()
    ]
    return reduce(DataFrame.unionByName, rows).orderBy("rmse", "model")

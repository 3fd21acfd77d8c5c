"""Sample, split, fit several price models, compare them with the constant baseline."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.functions.hashing import digest
from lotbook.operators import models as M
from lotbook.operators.clean import drop_incomplete, drop_repeats
from lotbook.operators.evaluate import leaderboard
from lotbook.operators.sampling import digest_cutoff, split
from lotbook.session import staged

KEY = "row_key"
Fit = Callable[[DataFrame], PipelineModel]

# The settings of the final run; its 100,000 rows are an argument, ``sample=SAMPLE``.
SAMPLE = 100_000
TEST_SIZE = 0.10
FITS: dict[str, Fit] = {
    "boosting": lambda train: M.fit_boosting(train, ignore=[KEY], rounds=1500, depth=5, rate=0.01),
    "linear": lambda train: M.fit_linear(train, ignore=[KEY]),
    "forest": lambda train: M.fit_forest(train, ignore=[KEY], trees=500, depth=10),
}


@dataclass
class Comparison:
    models: dict[str, PipelineModel]
    leaderboard: DataFrame
    importances: dict[str, DataFrame]


def with_row_key(df: DataFrame, name: str = KEY) -> DataFrame:
    """A key made of the whole row, unique once repeated rows are gone."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256))


def compare_models(
    table: DataFrame,
    label: str = "price",
    fits: Mapping[str, Fit] = FITS,
    sample: int | None = None,
    test_size: float = TEST_SIZE,
    seed: int = 10,
) -> Comparison:
    """Distinct complete rows (a sample of them only if ``sample`` says how many), train and test rows, models, scores.

    Equal rows have equal keys, so the sample is chosen among the distinct keys, and whole rows are
    compared only within the sample. It is written once, since every model reads it several times.
    """
    rows = with_row_key(drop_incomplete(table))
    if sample is None:
        rows = staged(drop_repeats(rows), "distinct")
    else:
        keys = staged(rows.select(KEY).distinct(), "keys")
        chosen = rows.where(digest(KEY, seed) <= F.lit(digest_cutoff(keys, sample, KEY, seed)))
        # a small sample of a large table is left in many tiny pieces; training wants one per core
        cores = rows.sparkSession.sparkContext.defaultParallelism
        rows = staged(drop_repeats(chosen).repartition(cores), "sample")
    # the sample took the lowest digests of this seed, so the split needs another one
    train, test = split(rows, test_size, KEY, seed + 1)
    models = {name: fit(train) for name, fit in fits.items()}
    scores = leaderboard({name: M.predict(model, test, [label]) for name, model in models.items()}, label, rows=test)
    heavy = {
        name: M.importances(model, train)
        for name, model in models.items()
        if hasattr(model.stages[-1], "featureImportances")
    }
    return Comparison(models, scores, heavy)

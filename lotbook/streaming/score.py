"""Predictions for listings as they arrive, by a saved model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lotbook.operators.models import load_model
from lotbook.schemas import LISTINGS_RAW, NA_WORDS
from lotbook.streaming.ingest import listing_stream, write_stream


def numeric_inputs(model: PipelineModel, df: DataFrame) -> list[str]:
    """Columns of ``df`` that enter the feature vector as they are."""
    assemblers = [s for s in model.stages if isinstance(s, VectorAssembler)]
    return [c for a in assemblers for c in a.getInputCols() if c in df.columns]


def _missing(column: str, df: DataFrame) -> Column:
    null = F.col(f"`{column}`").isNull()
    kind = df.schema[column].dataType
    return null | F.isnan(f"`{column}`") if isinstance(kind, (T.DoubleType, T.FloatType)) else null


def predict_arriving(model: PipelineModel, rows: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns to keep and a prediction, for a stream as for a table. The label need not be there.

    The feature vector refuses missing numbers, which would stop a stream for good; here a row without one of its
    numbers has no prediction (null). Missing and unseen texts have a slot of their own.
    """
    keep = rows.columns if keep is None else list(keep)
    numbers = numeric_inputs(model, rows)
    missing = reduce(Column.__or__, [_missing(c, rows) for c in numbers], F.lit(False))
    whole = rows.select("*", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), missing.alias("_missing"))
    filled = whole.withColumns({c: F.when(_missing(c, rows), F.lit(0)).otherwise(F.col(f"`{c}`")) for c in numbers})
    scored = model.transform(filled)
    return scored.select("_row.*", F.when(~F.col("_missing"), F.col("prediction")).alias("prediction"))


def score_stream(spark: SparkSession, model_path: str, folder: str, out: str, checkpoint: str,
                 schema: T.StructType = LISTINGS_RAW, keep: Sequence[str] | None = None,
                 na_words: Sequence[str] = NA_WORDS, files_per_trigger: int = 100) -> StreamingQuery:
    """Listing files → predictions of the saved model in a parquet table, each row once.

    Takes up all files that are there, in as many triggers as needed, then stops; run again with the same
    checkpoint, it takes up only new ones. Nothing is shuffled and nothing is kept between triggers.
    """
    rows = listing_stream(spark, folder, schema, na_words, files_per_trigger)
    return write_stream(predict_arriving(load_model(model_path), rows, keep), out, checkpoint)

"""Feature columns and feature vectors. The label is never among the features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import (
    Bucketizer,
    MinMaxScaler,
    OneHotEncoder,
    StringIndexer,
    TargetEncoder,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.operators.clean import columns_of_type
from lotbook.operators.quantiles import exact_quantiles
from lotbook.operators.stats import min_max
from lotbook.session import staged

# Every text value becomes a label that the driver holds; more than this is no category but free text.
MAX_VALUES = 200_000

# A table with more dummy columns than this should use the sparse vector form (feature_stages).
MAX_DUMMIES = 5_000
MISSING = "nan"

# Endings of intermediate columns, and the name Spark gives to the slot of missing values.
INDEX, CODED, UNKNOWN = "__index", "__coded", "__unknown"
MEAN = "__mean"

# Target statistics: parts the train rows are dealt into, and how many rows of the overall mean each value starts with.
FOLDS, SMOOTHING = 5, 10.0


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, max_columns: int = MAX_DUMMIES) -> DataFrame:
    """Replace each text column by one 0/1 column per value, named column_value, and one for null."""
    columns = columns_of_type(df, T.StringType) if columns is None else list(columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    found = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct().limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError(f"more than {max_columns} values in {columns}: use feature_stages instead")
    values = {c: sorted(r["value"] for r in found if r["column"] == c) for c in columns}
    dummies = [
        F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for c in columns for v in values[c]
    ]
    missing = [F.col(c).isNull().cast("int").alias(f"{c}_{MISSING}") for c in columns]
    return df.select(*[c for c in df.columns if c not in columns], *dummies, *missing)


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale columns to [0, 1] by their own range; a constant column becomes 0."""
    ranges = min_max(df, columns).select(F.struct("*").alias("_r")).scalar()
    ranged = df.withColumn("_r", ranges)
    scaled = {}
    for c in columns:
        lo, hi = F.col(f"_r.min_{c}").cast("double"), F.col(f"_r.max_{c}").cast("double")
        x = F.col(c).cast("double")
        scaled[c] = F.when(x.isNotNull(), F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0))
    return ranged.withColumns(scaled).drop("_r")


def value_estimates(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """About how many values each column has, from one pass with a sketch."""
    if not columns:
        return {}
    return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()


def feature_stages(
    df: DataFrame,
    label: str,
    ignore: Sequence[str] = (),
    encoding: str = "one_hot",
    scaled: bool = False,
) -> list[Estimator | Transformer]:
    """Stages that turn the columns of ``df`` into a ``features`` vector; fit them on train rows only.

    ``one_hot``: one slot per value and one for null or unseen values. ``index``: one slot per
    column, which tree models treat as a set of categories; much smaller for trees, which keep a
    dense row of all slots. ``scaled`` maps every slot to [0, 1]. A text column with too many values to
    be a category is refused.
    """
    taken = {label, *ignore}
    text = [c for c in columns_of_type(df, T.StringType) if c not in taken]
    too_many = [c for c, n in value_estimates(df, text).items() if n > MAX_VALUES]
    if too_many:
        raise ValueError(f"more than {MAX_VALUES} values in {too_many}: ignore these columns or group their values")
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in taken]
    stages: list[Estimator | Transformer] = []
    inputs = list(numeric)
    if text:
        indexed = [f"{c}{INDEX}" for c in text]
        stages.append(
            StringIndexer(inputCols=text, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc")
        )
        if encoding == "one_hot":
            coded = [f"{c}{CODED}" for c in text]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=False))
            inputs += coded
        elif encoding == "index":
            inputs += indexed
        else:
            raise ValueError("encoding is 'one_hot' or 'index'")
    assembled = "assembled" if scaled else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=assembled, handleInvalid="error"))
    if scaled:
        stages.append(MinMaxScaler(inputCol=assembled, outputCol="features"))
    return stages


def tree_features(train: DataFrame, label: str, ignore: Sequence[str] = (), max_bins: int = 64,
                  fold: Column | None = None, folds: int = FOLDS) -> tuple[PipelineModel, DataFrame]:
    """Feature stages for trees, fitted on ``train``, and ``train`` with its ``features``.

    Text columns of fewer values than bins are categories. A tree would need a bin for every value of a wider one, in
    every statistic it sends around, so those become a number: the mean label of the value, drawn towards the mean of all by
    ``SMOOTHING`` rows. New rows get the means over all train rows (the overall one for unseen values); a train row gets means over the
    other parts of the train rows, so that its own label is not among its features. ``fold`` says what part a row is in;
    by default its content does.
    """
    stages = feature_stages(train, label, ignore, "index")
    indexers = [s for s in stages if isinstance(s, StringIndexer)]
    fitted: list[Transformer] = [s.fit(train) for s in indexers]
    indexed = fitted[0].transform(train) if fitted else train
    text = fitted[0].getInputCols() if fitted else []
    wide = [c for c, labels in zip(text, fitted[0].labelsArray if fitted else []) if len(labels) + 1 > max_bins]
    inputs = [c for c in stages[-1].getInputCols() if c.removesuffix(INDEX) not in wide or not c.endswith(INDEX)]
    assembler = VectorAssembler(inputCols=[*inputs, *[f"{c}{MEAN}" for c in wide]], outputCol="features", handleInvalid="error")
    if wide:
        encoder = TargetEncoder(
            inputCols=[f"{c}{INDEX}" for c in wide], outputCols=[f"{c}{MEAN}" for c in wide], labelCol=label,
            targetType="continuous", smoothing=SMOOTHING, handleInvalid="keep",
        )
        fitted.append(encoder.fit(indexed))
        fold = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in train.columns]), F.lit(folds)) if fold is None else fold
        indexed = out_of_fold_means(indexed, wide, label, fold)
    return PipelineModel([*fitted, assembler]), assembler.transform(indexed)


def out_of_fold_means(indexed: DataFrame, columns: Sequence[str], label: str, fold: Column) -> DataFrame:
    """Adds for each indexed column the mean label of its value over the rows of the other folds.

    One pass gives sums for each column, value and fold, a table that does not grow with the rows. It is written, so that its size is
    known where it is joined back.
    """
    marked = indexed.withColumn("_fold", fold)
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}{INDEX}").alias("value")) for c in columns])
    long = marked.select(F.inline(values), "_fold", F.col(label).cast("double").alias("_y"))
    parts = staged(long.groupBy("column", "value", "_fold").agg(F.sum("_y").alias("s"), F.count("_y").alias("n")), "target-sums")
    overall = parts.where(F.col("column") == columns[0]).agg((F.sum("s") / F.sum("n")).alias("m")).first()["m"]
    totals = parts.groupBy("column", "value").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rows = F.col("all_n") - F.col("n") + SMOOTHING
    means = parts.join(totals, ["column", "value"]).select(
        "column", "value", "_fold", ((F.col("all_s") - F.col("s") + SMOOTHING * F.lit(overall)) / rows).alias("mean")
    )
    means = staged(means, "target-means")
    for c in columns:
        own = means.where(F.col("column") == c).select(F.col("value").alias(f"{c}{INDEX}"), "_fold", F.col("mean").alias(f"{c}{MEAN}"))
        marked = marked.join(own, [f"{c}{INDEX}", "_fold"], "left")
    return marked.drop("_fold")


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the slots of an assembled vector, as column or column_value."""
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for kind in attributes.values() for a in kind)
    names = [name.removesuffix(INDEX).removesuffix(MEAN).replace(f"{CODED}_", "_", 1) for _, name in slots]
    return [n.removesuffix(UNKNOWN) + MISSING if n.endswith(f"_{UNKNOWN}") else n for n in names]


def source_column(slot: str, columns: Sequence[str]) -> str:
    """The table column a slot comes from."""
    matches = [c for c in columns if slot == c or slot.startswith(f"{c}_")]
    return max(matches, key=len) if matches else slot


def price_bands(df: DataFrame, n: int | None = None, edges: Sequence[float] | None = None, label: str = "price",
                name: str = "band") -> tuple[DataFrame, list[float]]:
    """Number the price band of each row, 0.0 up, with fixed inner ``edges`` or ``n`` equally full bands.

    Returns the edges too, so that other rows (a test set) can be put into the same bands.
    """
    if edges is None:
        if not n or n < 2:
            raise ValueError("give the number of bands (2 or more) or their inner edges")
        probs = [i / n for i in range(1, n)]
        found = exact_quantiles(df, label, probs).collect()  # n - 1 rows
        edges = sorted(r["quantile"] for r in found)
        if len(set(edges)) < len(edges):
            raise ValueError(f"{n} bands need {n - 1} different edges; so many equal values give {edges}")
    inner = [float(e) for e in edges]
    bands = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")], inputCol=label, outputCol=name, handleInvalid="error"
    )
    return bands.transform(df), inner


"""Projection, filters, null removal, dedupe and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.functions.cells import NUMBER, WHOLE_NUMBER
from lotbook.schemas import RAW_POSITIONS


def project_positional(df: DataFrame, names: Mapping[int, str] = RAW_POSITIONS) -> DataFrame:
    """Choose columns by position and name them; positions not mentioned are left out."""
    return df.select(*[F.col(f"`{df.columns[at]}`").alias(name) for at, name in names.items()])


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def one_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def is_complete(df: DataFrame) -> Column:
    """No column is null (or NaN). As a list of plain conditions, which reach the file scan;
    ``na.drop`` is one opaque condition that does not."""
    complete = F.lit(True)
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        complete = complete & cell.isNotNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            complete = complete & ~F.isnan(cell)
    return complete


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Remove rows with a missing value in any column."""
    return df.where(is_complete(df))


def drop_repeats(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows. Copies meet in the map-side aggregate first, so a row
    that is repeated very often is not a hot key in the shuffle."""
    return df.dropDuplicates()


def stage_counts(df: DataFrame) -> DataFrame:
    """Rows before cleaning, after dedupe, and after the removal of incomplete rows.

    One pass over the data: the distinct rows carry their number of copies.
    """
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_copies"))
    totals = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("all_rows"),
        F.count("*").alias("no_repeats"),
        F.count_if(is_complete(df)).alias("complete"),
    )
    stages = F.array(
        *[
            F.struct(F.lit(place).alias("step"), F.lit(name).alias("stage"), F.col(name).alias("n_rows"))
            for place, name in enumerate(("all_rows", "no_repeats", "complete"))
        ]
    )
    return totals.select(F.inline(stages))


def whole_number(df: DataFrame, column: str) -> DataFrame:
    """Strict cast to int: a value that is no whole number stops the query."""
    return df.withColumn(column, F.col(column).cast("int"))


def with_age(df: DataFrame, ref_year: int = 2020) -> DataFrame:
    """Replace ``year`` by ``age`` counted back from ``ref_year``."""
    return df.withColumn("age", F.lit(ref_year) - F.col("year").cast("int")).drop("year")


def split_label(df: DataFrame, label: str = "price") -> tuple[DataFrame, DataFrame]:
    """The features without the label, and the label alone."""
    return df.drop(label), df.select(label)


def columns_of_type(df: DataFrame, kind: type[T.DataType] = T.StringType) -> list[str]:
    """Names of the columns of one type, from the schema alone."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def schema_table(df: DataFrame) -> DataFrame:
    """column, type: one row per column."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def tighten_types(df: DataFrame) -> DataFrame:
    """Give each text or double column the narrowest type that holds all of its values.

    Text becomes bigint, double or boolean if every value reads as such; doubles without a fraction
    become bigint. One aggregate over the table decides for all columns.
    """
    tests: dict[str, list[tuple[str, Column]]] = {}
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            tests[field.name] = [
                ("bigint", cell.rlike(WHOLE_NUMBER) & cell.try_cast("bigint").isNotNull()),
                ("double", cell.rlike(NUMBER) & cell.try_cast("double").isNotNull()),
                ("boolean", F.lower(cell).isin("true", "false")),
            ]
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            whole = (cell == F.floor(cell)) & (F.abs(cell) < F.lit(2.0**53))
            tests[field.name] = [("bigint", whole)]
    if not tests:
        return df
    verdict = df.agg(
        *[
            F.bool_and(F.when(F.col(f"`{name}`").isNotNull(), holds)).alias(f"{name}|{target}")
            for name, candidates in tests.items()
            for target, holds in candidates
        ]
    ).first()
    chosen = {}
    for name, candidates in tests.items():
        fitting = [target for target, _ in candidates if verdict[f"{name}|{target}"]]
        if fitting:
            chosen[name] = F.col(f"`{name}`").cast(fitting[0])
    return df.withColumns(chosen) if chosen else df


def with_segment(df: DataFrame, segments: Mapping[str, Sequence[str]], column: str = "make",
                 name: str = "segment") -> DataFrame:
    """Label rows by the list their value belongs to; rows in no list get null."""
    label = F.lit(None).cast("string")
    for segment, values in reversed(list(segments.items())):
        label = F.when(F.col(column).isin(*values), F.lit(segment)).otherwise(label)
    return df.withColumn(name, label)

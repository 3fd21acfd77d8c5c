"""Text cells to typed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.schemas import NA_WORDS

# ``try_cast`` alone would accept type suffixes such as 5d, so the shape is checked first.
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ZERO_DECIMALS = r"^\s*([+-]?\d+)\.0*\s*$"


def known(cell: Column, na_words: Sequence[str] = NA_WORDS) -> Column:
    """The cell, or null where it holds one of the missing-value words."""
    return F.when(~cell.isin(*na_words), cell)


def number(cell: Column) -> Column:
    """The cell as a double, or null where it is no plain number."""
    return F.when(cell.rlike(NUMBER), cell.try_cast("double"))


def typed(cell: Column, dtype: T.DataType, na_words: Sequence[str] = NA_WORDS) -> Column:
    """A text cell as ``dtype``. Whole numbers may be written with a decimal part of zero (2015.0); other
    decimal numbers are no whole numbers and give null. Whole numbers are never read as doubles."""
    cell = known(cell, na_words)
    if isinstance(dtype, T.StringType):
        return cell
    if isinstance(dtype, T.IntegralType):
        whole = F.when(cell.rlike(WHOLE_NUMBER), F.trim(cell)).otherwise(F.regexp_extract(cell, ZERO_DECIMALS, 1))
        plain = F.nullif(whole, F.lit("")).try_cast(dtype)
        return F.coalesce(plain, F.when(cell.rlike("[eE]") & (number(cell) % 1 == 0), number(cell)).try_cast(dtype))
    return number(cell).try_cast(dtype)


def typed_columns(df: DataFrame, schema: T.StructType, na_words: Sequence[str] = NA_WORDS) -> list[Column]:
    """One typed column per field of ``schema``, from text columns of the same names."""
    return [typed(F.col(f"`{f.name}`"), f.dataType, na_words).alias(f.name) for f in schema.fields]

"""Scans and writes of listing files."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from lotbook.functions.cells import typed_columns
from lotbook.operators.rows import with_row_id
from lotbook.schemas import LISTINGS_RAW, NA_WORDS, RENAMES, ZIP_CODES, as_text

LINE = "_line"  # the whole line, where its cells are not as many as the columns
MARK = "\u0001\u0002"
FILES_A_JOB = 200  # whose first lines are read together


def read_listings(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = LISTINGS_RAW,
    na_words: Sequence[str] = NA_WORDS,
    file_column: str | None = None,
) -> DataFrame:
    """Headerless CSV files, all in one scan. Cells are read as text, then typed, so that
    missing-value words and numbers written as 2015.0 survive in numeric columns.

    ``file_column`` adds the name of the file each row came from. A line with more cells than columns is
    no row, as its cells cannot be told apart; ``surplus_lines`` has those lines.
    """
    text = with_line(spark.read, schema).csv(paths if isinstance(paths, str) else list(paths))
    columns = typed_columns(text, schema, na_words)
    if file_column:
        columns.append(F.col("_metadata.file_name").alias(file_column))
    return text.where(~is_surplus(text)).select(*columns)


def surplus_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = LISTINGS_RAW) -> DataFrame:
    """file, cells (up to the first one too many), line (the whole of it): the lines that ``read_listings`` leaves out."""
    return rejects_of(with_line(spark.read, schema).csv(paths if isinstance(paths, str) else list(paths)))


def with_line(reader: DataFrameReader | DataStreamReader, schema: T.StructType) -> DataFrameReader | DataStreamReader:
    """Read cells as text, and beside them the line if there are more or fewer."""
    wide = T.StructType([*as_text(schema).fields, T.StructField(LINE, T.StringType())])
    return reader.schema(wide).option("columnNameOfCorruptRecord", LINE)


def _cells(line: Column, count: int) -> list[Column]:
    cells = F.from_csv(line, ", ".join(f"c{i} string" for i in range(count)))
    return [cells[f"c{i}"] for i in range(count)]


def is_surplus(text: DataFrame) -> Column:
    """Whether a line has more cells than there are columns, empty ones included. ``text``: as read by ``with_line``."""
    names = [c for c in text.columns if c != LINE]
    # marks put behind the line fill up a short one, and stay out of the columns of one that is too long
    *cells, last = _cells(F.concat(F.col(LINE), F.lit(f",{MARK}" * len(names))), len(names) + 1)
    fits = F.coalesce(last == MARK, F.lit(False))
    for cell in cells:
        fits |= F.coalesce(cell.contains(MARK), F.lit(False))
    # all columns are named, as Spark compares a line only with the columns it reads
    read = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in names])) >= 0
    return F.when(F.col(LINE).isNotNull() & read, ~fits).otherwise(False)


def reject_columns(file: Column, n_columns: int) -> list[Column]:
    """file, cells (up to the first one too many), line"""
    cells = F.array(*_cells(F.col(LINE), n_columns + 1))
    return [file.alias("file"), cells.alias("cells"), F.col(LINE).alias("line")]


def rejects_of(text: DataFrame) -> DataFrame:
    """file, cells, line: the lines with more cells than columns. ``text``: as read by ``with_line``."""
    return text.where(is_surplus(text)).select(*reject_columns(F.col("_metadata.file_name"), len(text.columns) - 1))


def read_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    renames: Mapping[str, str] = RENAMES,
    na_words: Sequence[str] = NA_WORDS,
) -> DataFrame:
    """CSV files with a header line. Header spellings are mapped to canonical names and columns are
    found by name; a column of ``schema`` that a file lacks is null, extra columns are not read. A line with more cells
    than its header is no row; ``surplus_table_lines`` has those lines.

    Files may differ in their columns: their first lines, and no more, are read first, and files of one layout are one scan. A
    layout with no column of ``schema`` at all is refused.
    """
    frames = []
    for names, text in _texts(spark, paths, renames):
        if not {f.name for f in schema.fields} & set(names):
            raise ValueError(f"no column of {schema.fieldNames()} in the header {names} of {text.inputFiles()[0]}")
        named = text.where(~is_surplus(text)).select(*[
            (F.col(f"c{names.index(f.name)}") if f.name in names else F.lit(None).cast("string")).alias(f.name) for f in schema.fields
        ])
        frames.append(named.select(*typed_columns(named, schema, na_words)))
    return reduce(DataFrame.unionAll, frames) if frames else spark.createDataFrame([], schema)


def surplus_table_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, cells, line: the lines that ``read_table`` leaves out, as they have more cells than their header."""
    frames = [rejects_of(text) for _, text in _texts(spark, paths, {})]
    return reduce(DataFrame.unionAll, frames) if frames else spark.createDataFrame([], "file string, cells array<string>, line string")


def _texts(spark: SparkSession, paths: str | Sequence[str], renames: Mapping[str, str]) -> Iterator[tuple[list[str], DataFrame]]:
    """Column names of each layout, and its cells (c0, c1, ...) with their lines."""
    for header, files in _layouts(spark, [paths] if isinstance(paths, str) else list(paths)):
        names = [renames.get(name, name) for name in next(csv.reader([header]))]
        cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        yield names, with_line(spark.read, cells).option("header", True).csv(files)


def first_lines(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """(path, first line) of each file that is not empty.

    A file is one task, which stops after its first line, so one buffer of each file is read however long it is. The driver
    sees one line a file; it has to list the files anyway.
    """
    heads = spark.newSession()  # settings of its own: no file is cut, and no two files share a task
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        heads.conf.set(name, str(1 << 40))
    found = [unquote(f) for f in heads.read.text(list(paths)).inputFiles()]
    lines = []
    for at in range(0, len(found), FILES_A_JOB):
        firsts = [heads.read.text(f).limit(1).select(F.lit(f).alias("path"), "value") for f in found[at : at + FILES_A_JOB]]
        lines += [(r["path"], r["value"]) for r in reduce(DataFrame.unionAll, firsts).collect()]
    return lines


def _layouts(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """Header lines and the files that begin with them."""
    layouts: dict[str, list[str]] = {}
    for path, header in first_lines(spark, paths):
        layouts.setdefault(header, []).append(path)
    return sorted((header, sorted(files)) for header, files in layouts.items())


def read_zip_codes(spark: SparkSession, path: str) -> DataFrame:
    """The ``zip`` column of a reference table with a header."""
    return read_table(spark, path, ZIP_CODES)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def append_listings(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Add rows to a table kept as one folder per shard.

    The rebalance hint gathers each shard into few files and, unlike a repartition by shard,
    splits a shard that is much larger than the others.
    """
    df.hint("rebalance", F.col(shard)).write.mode("append").partitionBy(shard).parquet(path)


def append_batch(df: DataFrame, path: str, batch: int, shard: str | None = "shard") -> None:
    """Add the rows of a numbered batch to a table kept by batch, and within it by shard.

    Added again, a batch replaces itself and touches no other, so a run that failed half way can be repeated.
    """
    target = f"{path.rstrip('/')}/batch={int(batch)}"
    if shard is None:
        df.write.mode("overwrite").parquet(target)
    else:
        df.hint("rebalance", F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(target)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table written by ``append_batch``."""
    return spark.read.parquet(path).drop("batch")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and without a row index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_csv_with_row_id(df: DataFrame, path: str, order_by: Sequence[str], name: str = "row_id") -> None:
    """CSV with a header and a leading dense row number in the order of a unique key."""
    numbered = with_row_id(df, order_by, name)
    write_csv(numbered.select(name, *df.columns), path)

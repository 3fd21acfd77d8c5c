"""Continual ingest of listing files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lotbook.functions.cells import typed_columns
from lotbook.operators.clean import drop_incomplete
from lotbook.schemas import LISTINGS_RAW, NA_WORDS
from lotbook.sources import store as stores
from lotbook.sources.files import append_batch, is_surplus, reject_columns, rejects_of, with_line


def listing_stream(spark: SparkSession, folder: str, schema: T.StructType = LISTINGS_RAW,
                   na_words: Sequence[str] = NA_WORDS, files_per_trigger: int = 100,
                   arrival: str | None = None) -> DataFrame:
    """Headerless CSV files as they arrive, typed as in ``read_listings``. ``arrival`` adds the time of the file.

    As there, a line with more cells than columns is no row; ``surplus_stream`` has those lines.
    """
    text = with_line(spark.readStream, schema).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    columns = typed_columns(text, schema, na_words)
    if arrival:
        columns.append(F.col("_metadata.file_modification_time").alias(arrival))
    return text.where(~is_surplus(text)).select(*columns)


def surplus_stream(spark: SparkSession, folder: str, schema: T.StructType = LISTINGS_RAW, files_per_trigger: int = 100) -> DataFrame:
    """file, cells, line: what ``listing_stream`` leaves out, as in ``surplus_lines``."""
    return rejects_of(with_line(spark.readStream, schema).option("maxFilesPerTrigger", files_per_trigger).csv(folder))


def clean_stream(rows: DataFrame, arrival: str | None = None, delay: str = "2 days") -> DataFrame:
    """Remove incomplete rows, then repeats.

    Without an arrival time every distinct row stays in the state for good. With one, a row is
    remembered for ``delay`` after its arrival, so the state stays as large as that span of data.
    """
    rows = drop_incomplete(rows)
    if arrival is None:
        return rows.dropDuplicates()
    keys = [c for c in rows.columns if c != arrival]
    return rows.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(keys)


def write_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet table all that is there now, in as many triggers as needed, then stop."""
    return (
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str,
                  schema: T.StructType = LISTINGS_RAW, files_per_trigger: int = 100,
                  delay: str | None = None) -> StreamingQuery:
    """Listing files → clean, distinct rows in a parquet table. Run again with the same checkpoint, it
    takes up only new files.

    With a ``delay`` a row is remembered for so long after its file arrived, which bounds the state; without one
    repeats are found however late they come, and every distinct row stays in the state.

    Lines with more cells than columns are written first, by a query of their own, to ``out`` + "-rejects".
    """
    rejects = surplus_stream(spark, folder, schema, files_per_trigger)
    write_stream(rejects, f"{out.rstrip('/')}-rejects", f"{checkpoint.rstrip('/')}-rejects").awaitTermination()
    arrival = "_arrived" if delay else None
    rows = listing_stream(spark, folder, schema, files_per_trigger=files_per_trigger, arrival=arrival)
    rows = clean_stream(rows, arrival, delay).drop("_arrived") if delay else clean_stream(rows)
    return write_stream(rows, out, checkpoint)


REJECTS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("line", T.StringType())
])


def ingest_to_store(spark: SparkSession, folder: str, store: stores.Store, checkpoint: str,
                    na_words: Sequence[str] = NA_WORDS, files_per_trigger: int = 100,
                    stop_before: int | None = None) -> StreamingQuery:
    """Listing files → clean rows that the store does not have, and its rejects, both exactly once.

    Files are read once for rows and rejects, as far as a trigger fits into the memory for it. A trigger is a batch of the store under the number that Spark gives it; a trigger
    that was stopped between two writes is run again with the same files and number, and replaces what it left. Repeats are
    found in the store, however late they come, so the stream itself keeps no state. ``stop_before`` fails that batch between
    its two writes, as a rehearsal.
    """
    text = with_line(spark.readStream, store.schema).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    cells = text.select("*", "_metadata.file_name")

    def add(batch: DataFrame, number: int) -> None:
        # what does not fit is read again; on disk it would be larger than the files it was read from
        judged = batch.withColumn("_surplus", is_surplus(batch.drop("file_name"))).persist(StorageLevel.MEMORY_ONLY)
        try:
            lines = judged.where("_surplus").select(*reject_columns(F.col("file_name"), len(store.schema)))
            append_batch(lines, f"{store.path}/rejects", number, None)
            if number == stop_before:
                raise RuntimeError(f"stopped before batch {number}")
            rows = judged.where("not _surplus").select(*typed_columns(judged, store.schema, na_words))
            stores.add_batch(drop_incomplete(rows), store, number)
        finally:
            judged.unpersist()

    return (
        cells.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stored_rejects(spark: SparkSession, store: stores.Store) -> DataFrame:
    """file, cells, line of all batches that count"""
    return stores.read_store(spark, store, "rejects", REJECTS)

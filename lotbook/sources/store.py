"""A listing table that grows by numbered batches.

    <path>/rows/batch=<number>/      the rows that a batch added, by shard if wanted
    <path>/rejects/batch=<number>/   lines of the batch that are no rows
    <path>/keys/batch=<number>/      a digest of each row, in buckets
    <path>/batches/batch=<number>/   written last: the batch counts
    <path>/settings/                 number of buckets

A batch that is added again, be it after a failure between two of these writes, replaces its own folders, so a table is
the same however often a batch was tried. New rows are found by an anti-join with the bucketed digests: the batch is
shuffled into their buckets, what is stored stays where it is.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.operators.clean import drop_repeats
from lotbook.sources.files import append_batch

BUCKETS = 64
BATCH = "batch"
KEY = "_key"


@dataclass(frozen=True)
class Store:
    path: str
    schema: T.StructType
    buckets: int
    keys: str  # name of the table of digests
    shard: str | None = None


def row_digest(schema: T.StructType) -> Column:
    """SHA-256 of the whole row; equal rows, and only they, have equal digests. Zero has no sign, as in a comparison."""
    cells = []
    for field in schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cell = cell + F.lit(0.0).cast(field.dataType)
        cells.append(cell.alias(field.name))
    return F.unhex(F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256))


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at a path; empty if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def open_store(spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS, shard: str | None = None) -> Store:
    """A new store, or the one at ``path``, which keeps the number of buckets it was made with."""
    path = path.rstrip("/")
    settings = _stored(spark, f"{path}/settings", T.StructType.fromDDL("buckets int")).collect()
    buckets = settings[0]["buckets"] if settings else buckets
    name = f"lotbook_keys_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"""
        create table if not exists {name} ({KEY} binary, {BATCH} bigint) using parquet partitioned by ({BATCH})
        clustered by ({KEY}) sorted by ({KEY}) into {buckets} buckets location '{path}/keys'""")
    if settings:
        spark.sql(f"alter table {name} recover partitions")
    else:  # an empty batch makes the folder; the settings come last, so a store that has them is whole
        spark.sql(f"insert overwrite table {name} partition ({BATCH} = -1) select cast(null as binary) where false")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    return Store(path, schema, buckets, name, shard)


def batches(spark: SparkSession, store: Store) -> DataFrame:
    """batch, n_rows: the batches that count."""
    return _stored(spark, f"{store.path}/batches", T.StructType.fromDDL(f"n_rows bigint, {BATCH} bigint")).select(BATCH, "n_rows")


def new_rows(rows: DataFrame, store: Store, batch: int) -> DataFrame:
    """The distinct rows that no earlier batch has, each with its digest.

    Copies within the batch meet in the map-side aggregate first. What is left is shuffled into the buckets of the
    digests, without them: 32 bytes that no codec shrinks cost more to move than to work out again. What is stored is read in
    place, whatever its size, so it is never broadcast.
    """
    spark = rows.sparkSession
    names, digest = store.schema.fieldNames(), row_digest(store.schema)
    distinct = drop_repeats(rows.select(*names)).repartition(store.buckets, digest).withColumn(KEY, digest)
    stored = spark.table(store.keys).where(F.col(BATCH) < batch).select(KEY).hint("merge")
    return distinct.join(stored, KEY, "left_anti")


def add_batch(rows: DataFrame, store: Store, batch: int) -> None:
    """Add the new rows of a batch. Numbers ascend; a batch that is there already is replaced by itself."""
    spark = rows.sparkSession
    known = batches(spark, store).agg(F.max(BATCH).alias("last"), F.bool_or(F.col(BATCH) == batch).alias("there")).first()
    if known["last"] is not None and batch < known["last"] and not known["there"]:
        raise ValueError(f"batch {batch} comes after batch {known['last']}")
    append_batch(new_rows(rows, store, batch).drop(KEY), f"{store.path}/rows", batch, store.shard)
    written = spark.read.schema(store.schema).parquet(f"{store.path}/rows/{BATCH}={int(batch)}")
    keys = written.select(row_digest(store.schema).alias(KEY)).repartition(store.buckets, KEY)
    spark.sql(f"insert overwrite table {store.keys} partition ({BATCH} = {int(batch)}) select {KEY} from {{keys}}", keys=keys)
    done = written.agg(F.count("*").alias("n_rows"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{store.path}/batches/{BATCH}={int(batch)}")


def read_store(spark: SparkSession, store: Store, table: str = "rows", schema: T.StructType | None = None) -> DataFrame:
    """The rows (or the rejects) of all batches that count."""
    schema = schema or store.schema
    whole = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    stored = _stored(spark, f"{store.path}/{table}", whole)
    return stored.join(batches(spark, store).select(BATCH), BATCH, "left_semi").select(*schema.fieldNames())

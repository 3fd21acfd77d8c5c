"""Dense row numbers without pulling the table through one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotbook.session import staged

# monotonically_increasing_id() keeps the place within the partition in its lower 33 bits.
PLACE_BITS = 33


def with_row_id(df: DataFrame, order_by: str | Sequence[str], name: str = "row_id") -> DataFrame:
    """Number the rows 0..n-1 in the order of a **unique** key.

    A distributed range sort gives every row its partition and its place there; both are written
    down in a staged table, so they cannot change when a task is retried. What reaches the driver is
    one count per partition.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    placed = staged(
        df.orderBy(*keys).select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"),
        ),
        "row-id",
    )
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)], "_part int, _start bigint"
    )
    # one row per partition of the sort: bounded by the number of shuffle partitions
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_start") + F.col("_place")).alias(name)
    )

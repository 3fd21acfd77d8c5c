"""Exact quantiles of any number of rows.

The built-in exact ``percentile`` keeps a map of all distinct values of a group in one task. Here a
mergeable sketch of fixed size first says *about* where each quantile lies; a second pass counts the
rows on either side of those marks; only the few rows between the two marks around a quantile are then
ordered, and where these are many, the same is done within them until a fixed number is left. The counts, not the sketch, decide which marks are used, so the result is exact whatever the
error of the sketch: a bad sketch would only widen the range that has to be ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.operators.clean import drop_incomplete
from lotbook.session import staged

# Distinct values around one quantile that a task puts in order; more of them are cut into cells first.
ORDERED = 100_000
CELLS = 256


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """by..., prob, n, quantile: linear interpolation between the two nearest ranks.

    Nulls in ``value`` or ``by`` do not count. Three column-pruned scans; two of them run right away.
    """
    return quantiles_and_aggregates(df, value, probs, by, accuracy)[0]


def quantiles_and_aggregates(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000,
    also: Sequence[Column] = (),
) -> tuple[DataFrame, DataFrame]:
    """As ``exact_quantiles``, and a table of further aggregates (over the column ``_v``), which share
    its first scan if there are groups."""
    by = list(by)
    rows = drop_incomplete(df.select(*by, F.col(value).cast("double").alias("_v")))
    marks = sorted({min(max(p + side * 2.0 / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)})

    first_pass = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", marks, accuracy).alias("_cuts"), *also
    )
    sketch, with_sketch = _once(first_pass, by)
    marked = with_sketch(rows, ["_cuts"])
    counts = {
        name: ", ".join(f"count_if(_v {sign} _cuts[{i}])" for i in range(len(marks)))
        for name, sign in (("_upto", "<="), ("_under", "<"))
    }
    counted = marked.groupBy(*by).agg(*[F.expr(f"array({each})").alias(name) for name, each in counts.items()])
    counted = with_sketch(counted, ["_n", "_cuts"]).where("_n > 0")
    around = F.array_max(F.expr("transform(_brackets, b -> b.upto - b.start.below)"))
    brackets = counted.select(*by, _brackets(probs).alias("_brackets")).withColumn("_around", around)
    most, with_brackets = _once(brackets, by, "_around")

    # a bracket without a bound is open there
    holds = F.expr("""filter(_brackets, b ->
        (b.start.lo is null or _v > b.start.lo or (b.start.closed and _v = b.start.lo))
        and (b.hi is null or _v <= b.hi))""")
    near = with_brackets(rows, ["_brackets"]).select(*by, "_v", F.explode(holds).alias("_b"))
    copies = near.groupBy(*by, "_b", "_v").agg(F.count("*").alias("_c")).withColumn("_below", F.col("_b.start.below"))
    if (most or 0) > ORDERED:
        copies = _narrowed(copies, by)
    so_far = F.sum("_c").over(
        Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = copies.withColumn("_upto", F.col("_below") + so_far)
    picked = ranked.groupBy(*by, "_b").agg(
        F.min(F.when(F.col("_upto") > F.col("_b.rank_lo"), F.col("_v"))).alias("_lower"),
        F.min(F.when(F.col("_upto") > F.col("_b.rank_hi"), F.col("_v"))).alias("_upper"),
    )
    quantile = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * F.col("_b.part")
    table = picked.select(*by, F.col("_b.prob").alias("prob"), F.col("_b.n").alias("n"), quantile.alias("quantile"))
    return table, sketch.drop("_n", "_cuts")


def _narrowed(copies: DataFrame, by: Sequence[str]) -> DataFrame:
    """Only the values around the two ranks of each bracket, few enough for a task to put in order.

    Each turn cuts the distinct values of a bracket into cells by a sketch, counts the rows of the cells, and keeps
    the cells that hold the ranks: two of ``CELLS`` at most. ``_below`` are the rows that come before what is kept.
    """
    keys = [*by, "_prob"]
    copies = copies.withColumn("_prob", F.col("_b.prob"))
    shares = [i / CELLS for i in range(1, CELLS)]
    while True:
        copies = staged(copies, "brackets")
        cuts = copies.groupBy(*keys).agg(F.count("*").alias("_d"), F.percentile_approx("_v", shares).alias("_cuts"))
        cuts = staged(cuts, "cells")
        if (cuts.agg(F.max("_d")).first()[0] or 0) <= ORDERED:
            return copies.drop("_prob")
        placed = copies.join(cuts.drop("_d"), keys).withColumn("_cell", F.expr("size(filter(_cuts, c -> c < _v))"))
        cells = placed.groupBy(*keys, "_cell").agg(
            F.sum("_c").alias("_rows"), F.min("_below").alias("_below"),
            F.min("_b.rank_lo").alias("_lo"), F.min("_b.rank_hi").alias("_hi"))
        so_far = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_cell"))  # at most CELLS rows
        cells = cells.withColumn("_end", F.col("_below") + so_far).where("_end > _lo and _end - _rows <= _hi")
        kept = cells.groupBy(*keys).agg(
            F.min(F.col("_end") - F.col("_rows")).alias("_below"), F.min("_cell").alias("_first"), F.max("_cell").alias("_last"))
        inside = placed.drop("_below").join(kept, keys).where("_cell between _first and _last")
        copies = inside.select(*copies.columns)


def _once(per_group: DataFrame, by: Sequence[str], top: str | None = None):
    """A table of one row per group (or the largest value of its column ``top``), worked out once, and how to put its
    columns next to other rows.

    Without groups its single row comes to the driver and goes back as constants. With groups it is
    written, so that its size is known: the optimiser broadcasts it if small, which leaves the data unshuffled;
    otherwise it plans a join, where adaptive execution splits hot groups.
    """
    if not by:
        found = per_group.first()  # nothing if there are no rows at all

        def constants(rows: DataFrame, columns: list[str]) -> DataFrame:
            values = [_constant(found and found[c], per_group.schema[c].dataType) for c in columns]
            return rows.selectExpr("*", *[f"{v} as {c}" for v, c in zip(values, columns)])

        return (found and found[top]) if top else per_group, constants

    table = staged(per_group, "groups")

    def joined(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.join(table.select(*by, *columns), list(by))

    return table.agg(F.max(top)).first()[0] if top else table, joined


def _constant(value, dtype: T.DataType) -> str:
    """A value of one result row as SQL text."""
    if value is not None and isinstance(dtype, T.ArrayType):
        return f"array({', '.join(_constant(v, dtype.elementType) for v in value)})"
    if value is not None and isinstance(dtype, T.StructType):
        return f"named_struct({', '.join(f"'{f.name}', {_constant(value[f.name], f.dataType)}" for f in dtype.fields)})"
    text = "null" if value is None else f"'{value!r}'"
    return f"cast({text} as {dtype.simpleString()})"


def _brackets(probs: Sequence[float]) -> Column:
    """For each quantile the range that holds its two ranks.

    The range starts above ``lo`` (at ``lo`` if closed, at the smallest value if null) and ends with
    ``hi`` (with the largest value if null); ``below`` rows come before it, ``upto`` rows end with it. A closed start keeps
    everything smaller than a very frequent value out of the range.
    """
    wanted = ", ".join(f"double('{float(p)!r}')" for p in probs)
    marks = "arrays_zip(_cuts, _upto, _under)"
    return F.expr(f"""
        transform(
            transform(array({wanted}), p -> named_struct('prob', p, 'at', p * (_n - 1))),
            q -> named_struct(
                'prob', q.prob, 'n', _n, 'part', q.at - floor(q.at), 'rank_lo', floor(q.at), 'rank_hi', ceil(q.at),
                'start', array_max(concat(
                    array(named_struct('below', 0L, 'lo', double(null), 'closed', false)),
                    transform(filter({marks}, m -> m._upto <= floor(q.at)),
                              m -> named_struct('below', m._upto, 'lo', m._cuts, 'closed', false)),
                    transform(filter({marks}, m -> m._under <= floor(q.at)),
                              m -> named_struct('below', m._under, 'lo', m._cuts, 'closed', true)))),
                'hi', array_min(transform(filter({marks}, m -> m._upto > ceil(q.at)), m -> m._cuts)),
                'upto', coalesce(array_min(transform(filter({marks}, m -> m._upto > ceil(q.at)), m -> m._upto)), _n)))
    """)


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., median"""
    return exact_quantiles(df, value, [0.5], by).select(*by, F.col("quantile").alias("median"))

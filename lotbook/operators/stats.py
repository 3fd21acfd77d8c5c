"""Counts, moments, histograms and t-tests."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.functions.distributions import normal_pdf, pooled_t, two_sided_p_column
from lotbook.functions.hashing import digest, standard_normal
from lotbook.operators.clean import drop_incomplete
from lotbook.operators.quantiles import quantiles_and_aggregates

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("p25", "p50", "p75")


def value_counts(df: DataFrame, column: str, k: int | None = 10) -> DataFrame:
    """The ``k`` most frequent values (all if ``k`` is None), ties by value; nulls do not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    return counts if k is None else counts.orderBy(F.desc("n_rows"), column).limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Each value once; null is a value."""
    return df.select(column).distinct()


def row_counts(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows per chosen value, and of the whole table (the row without a value), in one pass."""
    chosen = F.when(F.col(column).isin(*values), F.col(column))
    per_value = df.select(chosen.alias(column)).groupBy(column).agg(F.count("*").alias("n_rows"))
    return per_value.rollup(column).agg(F.sum("n_rows").alias("n_rows"), F.grouping(column).alias("_all")).where(
        (F.col("_all") == 1) | F.col(column).isNotNull()
    ).drop("_all")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """by..., column, count, mean, std (n-1), min, p25, p50, p75, max; exact quartiles unless ``approx``."""
    by = list(by)
    every = df.select(
        *by,
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns])
        ),
    )
    keys, long = [*by, "column"], every.where(F.col("_x").isNotNull())
    # columns without any value have a row too, of count 0
    blank = every.groupBy(*keys).agg(F.count("_x").alias("count")).where("count = 0")
    others = ("mean", "std", "min", *QUARTILE_NAMES, "max")
    blank = blank.select(*keys, "count", *[F.lit(None).cast("double").alias(c) for c in others])

    def aggregates(x: str) -> list[Column]:
        return [
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        ]

    if approx:
        table = long.groupBy(*keys).agg(
            *aggregates("_x"), F.percentile_approx("_x", list(QUARTILES)).alias("_q")
        )
        quartile_columns = [F.col("_q")[i].alias(q) for i, q in enumerate(QUARTILE_NAMES)]
        return table.select(*keys, "count", "mean", "std", "min", *quartile_columns, "max").unionAll(blank)
    quartiles, rest = quantiles_and_aggregates(long, "_x", QUARTILES, keys, also=aggregates("_v"))
    quartiles = quartiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(q) for p, q in zip(QUARTILES, QUARTILE_NAMES)]
    )
    return rest.join(quartiles, keys).select(*keys, "count", "mean", "std", "min", *QUARTILE_NAMES, "max").unionAll(blank)


def moments(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., n, mean, std (n-1)"""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: min_<column> and max_<column> of each column."""
    return df.agg(
        *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns]
    )


def ttest_pairs(
    df: DataFrame, value: str, group: str, pairs: Sequence[tuple[str, str]] | None = None,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """a, b, t, dof: two-sample t-test with pooled variance for the named pairs (or all pairs of the
    named ``groups``). The data is read for nothing but the moments of each group."""
    pairs = list(pairs) if pairs is not None else list(combinations(sorted(groups or ()), 2))
    named = sorted({name for pair in pairs for name in pair})
    per_group = (
        df.where(F.col(group).isin(*named))
        .groupBy(group)
        .agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    )
    wanted = df.sparkSession.createDataFrame([tuple(p) for p in pairs], "a string, b string")
    sides = [
        per_group.select(F.col(group).cast("string").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "m", "v")])
        for s in ("a", "b")
    ]
    both = wanted.join(sides[0], "a").join(sides[1], "b")
    t = pooled_t(*[F.col(f"{c}_{s}") for s in ("a", "b") for c in ("n", "m", "v")])
    dof = (F.col("n_a") + F.col("n_b") - 2).cast("double")
    return both.select("a", "b", t.alias("t"), dof.alias("dof"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """Adds the two-sided p-value, as a column: the continued fraction of Student's t is an aggregate over its terms."""
    return tests.withColumn("p", two_sided_p_column(F.col("t"), F.col("dof")))


def ttest_ind(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """a, b, t, dof, p for one pair of groups."""
    return with_p_values(ttest_pairs(df, value, group, [(a, b)]))


def bin_number(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based equal-width bin; the last bin is closed."""
    return F.least(F.floor((value - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int")


def _with_range(df: DataFrame, value: str) -> DataFrame:
    """Rows with the shared range of all of them, widened by half a unit on both sides if it is empty."""
    edges = df.agg(
        F.struct(
            F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")
        ).alias("_range")
    ).scalar()
    ranged = df.withColumn("_range", edges)
    same = F.col("_range.lo") == F.col("_range.hi")
    return ranged.withColumns(
        {
            "_lo": F.when(same, F.col("_range.lo") - 0.5).otherwise(F.col("_range.lo")),
            "_hi": F.when(same, F.col("_range.hi") + 0.5).otherwise(F.col("_range.hi")),
        }
    )


def _filled_bins(df: DataFrame, value: str, n: int, group: str, groups: Sequence[str] | None) -> DataFrame:
    """group, bin, lo, hi, n_rows, total: every bin of every group, and the rows of the group."""
    if groups is not None:
        df = df.where(F.col(group).isin(*groups))
    rows = _with_range(drop_incomplete(df.select(group, value)), value)
    where = bin_number(F.col(value), F.col("_lo"), F.col("_hi"), n)
    counts = rows.groupBy(group, where.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n_rows"))
    # from here on at most n entries per group
    per_group = counts.groupBy(group, "_lo", "_hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n_rows"))).alias("_counts"), F.sum("n_rows").alias("total")
    )
    filled = per_group.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / n
    return filled.select(
        group,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.element_at("_counts", F.col("bin")), F.lit(0)).cast("bigint").alias("n_rows"),
        "total",
    )


def histogram(df: DataFrame, value: str, n: int, group: str, groups: Sequence[str] | None = None) -> DataFrame:
    """group, bin, lo, hi, n_rows: equal-width bins on the range of all chosen groups, empty bins included."""
    return _filled_bins(df, value, n, group, groups).drop("total")


def density_histogram(df: DataFrame, value: str, n: int = 60, group: str | None = None,
                      groups: Sequence[str] | None = None) -> DataFrame:
    """As ``histogram``, with the share of the group's rows per unit of width; one group 'all' by default."""
    if group is None:
        group, df = "group", df.withColumn("group", F.lit("all"))
    density = F.col("n_rows") / (F.col("total") * (F.col("hi") - F.col("lo")))
    return _filled_bins(df, value, n, group, groups).withColumn("density", density).drop("total")


def normal_curve(df: DataFrame, value: str, n: int = 60, by: str | None = None, common: bool = False) -> DataFrame:
    """by, edge, x, y: the normal density with the group's mean and std at the n+1 bin edges of its range.

    ``common``: of the range of all groups, as the bins of ``density_histogram`` have it.
    """
    by_columns = [by] if by else []
    per_group = df.groupBy(*by_columns).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"),
        F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"),
    )
    if common:
        present = df.where(F.col(by).isNotNull()) if by else df
        ends = present.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("_e")).scalar()
        per_group = per_group.withColumn("_e", ends).withColumns({"_lo": F.col("_e.lo"), "_hi": F.col("_e.hi")})
    edges = per_group.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("edge"))
    x = F.col("_lo") + F.col("edge") * ((F.col("_hi") - F.col("_lo")) / n)
    return edges.withColumn("x", x).select(
        *by_columns, "edge", "x", normal_pdf(F.col("x"), F.col("_mean"), F.col("_std")).alias("y")
    )


def normal_draws(df: DataFrame, value: str, key: str, seed: int = 10) -> DataFrame:
    """key, draw: for each row one draw from the normal distribution with the mean and std of all rows.

    The draw follows from the row's key, so it is the same in every run and layout.
    """
    spread = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).alias("_s")).scalar()
    drawn = df.select(key, digest(key, seed).alias("_h")).withColumn("_s", spread)
    return drawn.select(key, (F.col("_s.mean") + F.col("_s.std") * standard_normal(F.col("_h"))).alias("draw"))


def normal_sample(df: DataFrame, value: str, n: int, seed: int = 10) -> DataFrame:
    """draw_id (0 to n-1), draw: ``n`` draws from the normal distribution with the mean and std of all rows, however many rows
    there are.

    A draw follows from its number and the seed, so a retried task draws the same; the numbers are made where they are
    used.
    """
    spread = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).alias("_s")).scalar()
    numbers = df.sparkSession.range(n).withColumnRenamed("id", "draw_id")
    drawn = numbers.select("draw_id", digest("draw_id", seed).alias("_h")).withColumn("_s", spread)
    return drawn.select("draw_id", (F.col("_s.mean") + F.col("_s.std") * standard_normal(F.col("_h"))).alias("draw"))


def scatter_bins(df: DataFrame, group: str, value: str, n: int, groups: Sequence[str] | None = None) -> DataFrame:
    """group, bin, n_rows: how many points a scatter of value by group would have in each value bin."""
    if groups is not None:
        df = df.where(F.col(group).isin(*groups))
    rows = _with_range(drop_incomplete(df.select(group, value)), value)
    where = bin_number(F.col(value), F.col("_lo"), F.col("_hi"), n)
    return rows.groupBy(group, where.alias("bin")).agg(F.count("*").alias("n_rows"))

"""Counts, moments, histograms, t-tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.queries.cleaning import COMPLETE, DIRTY, IN_TOP, LISTINGS, SEGMENTS, TOP_MAKES
from checks.registry import query
from checks.views import listings, listings_dirty, oracle_views, price_signal
from lotbook.operators import clean as C
from lotbook.operators import stats as A
from lotbook.operators.evaluate import constant_predictions, evaluate, r2_score
from lotbook.operators.quantiles import exact_median, exact_quantiles

SIGNAL = f"with {oracle_views('price_signal')}"


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "a1_top_makes",
    f"""{DIRTY}, d as (select distinct * from listings_dirty where {COMPLETE})
    select make, count(*) as n_rows from d group by make order by n_rows desc, make limit 10""",
)
def top_makes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = C.drop_repeats(C.drop_incomplete(listings_dirty(spark, sf_dir)))
    return A.value_counts(clean, "make")


def _counts(column: str, k: int) -> None:
    @query(
        f"a1_value_counts_{column}",
        f"""{DIRTY} select {column}, count(*) as n_rows from listings_dirty where {column} is not null
        group by 1 order by n_rows desc, {column} limit {k}""",
    )
    def counts(spark, sf_dir):
        return A.value_counts(listings_dirty(spark, sf_dir), column, k)


for _column, _k in (("model", 10), ("color", 10), ("year", 10), ("body_style", 12)):
    _counts(_column, _k)


@query("a2_distinct_colors", f"{DIRTY} select distinct color from listings_dirty")
def distinct_colors(spark, sf_dir):
    return A.distinct_values(listings_dirty(spark, sf_dir), "color")


@query(
    "a3_row_counts",
    f"""{DIRTY} select make, count(*) as n_rows from listings_dirty where make in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')
    group by 1 union all select null, count(*) from listings_dirty""",
)
def row_counts(spark, sf_dir):
    return A.row_counts(listings_dirty(spark, sf_dir), "make", ["Brand#1", "Brand#2", "Brand#3", "Brand#4"])


def _describe_sql(column: str, source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""select {keys}'{column}' as "column", count({column}) as count, round(avg({column}), 4) as mean,
        round(stddev_samp({column}), 4) as std, cast(min({column}) as double) as min,
        round(quantile_cont({column}, 0.25), 4) as p25, round(quantile_cont({column}, 0.5), 4) as p50,
        round(quantile_cont({column}, 0.75), 4) as p75, cast(max({column}) as double) as max
        from {source} {'group by ' + by if by else ''}"""


DESCRIBED = ("mean", "std", "p25", "p50", "p75")


@query(
    "a4_describe_make",
    f"{LISTINGS}, m as (select * from listings where make = 'Brand#3') "
    + " union all ".join(_describe_sql(c, "m") for c in ("price", "year", "mileage")),
)
def describe_make(spark, sf_dir):
    rows = C.equal_to(listings(spark, sf_dir), "make", "Brand#3")
    return rounded(A.describe(rows, ["price", "year", "mileage"]), *DESCRIBED)


@query(
    "a4_describe_all",
    f"{DIRTY} " + " union all ".join(_describe_sql(c, "listings_dirty") for c in ("price", "mileage")),
)
def describe_all(spark, sf_dir):
    return rounded(A.describe(listings_dirty(spark, sf_dir), ["price", "mileage"]), *DESCRIBED)


@query("a4_describe_by_make", f"{DIRTY} {_describe_sql('price', 'listings_dirty', 'make')}")
def describe_by_make(spark, sf_dir):
    return rounded(A.describe(listings_dirty(spark, sf_dir), ["price"], by=["make"]), *DESCRIBED)


@query(
    "a5_segment_moments",
    f"""{LISTINGS}, s as (select price, case when make in ('Brand#1', 'Brand#2') then 'common' else 'lux' end as segment
        from listings where make in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4'))
    select segment, count(*) as n, round(avg(price), 4) as mean, round(stddev_samp(price), 4) as std from s group by 1""",
)
def segment_moments(spark, sf_dir):
    rows = C.with_segment(listings(spark, sf_dir), SEGMENTS).where("segment is not null")
    return rounded(A.moments(rows, "price", ["segment"]), "mean", "std")


@query("a6_median", f"{DIRTY} select median(price) as median from listings_dirty")
def median(spark, sf_dir):
    return exact_median(listings_dirty(spark, sf_dir), "price")


@query(
    "a6_median_by_make",
    f"{DIRTY} select make, median(mileage) as median from listings_dirty group by 1",
)
def median_by_make(spark, sf_dir):
    return exact_median(listings_dirty(spark, sf_dir), "mileage", ["make"])


@query(
    "a6_extreme_quantiles",
    f"""{LISTINGS} select cast(p as double) as prob, (select count(*) from listings) as n, round(q, 4) as quantile from (
        select unnest([0.0, 0.001, 0.999, 1.0]) as p,
               unnest(quantile_cont(price, [0.0, 0.001, 0.999, 1.0])) as q from listings)""",
)
def extreme_quantiles(spark, sf_dir):
    return rounded(exact_quantiles(listings(spark, sf_dir), "price", [0.0, 0.001, 0.999, 1.0]), "quantile")


T_TEST = """select x.make as a, y.make as b,
    round((x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2) * (1.0 / x.n + 1.0 / y.n)), 6) as t,
    cast(x.n + y.n - 2 as double) as dof from g x join g y on """
GROUPS = f"{LISTINGS}, g as (select make, count(*) as n, avg(price) as m, var_samp(price) as v from listings group by 1)"


@query("a7_t_test", f"{GROUPS} {T_TEST} x.make = 'Brand#4' and y.make = 'Brand#1'")
def t_test(spark, sf_dir):
    result = A.ttest_ind(listings(spark, sf_dir), "price", "make", "Brand#4", "Brand#1")
    return rounded(result.drop("p"), "t", digits=6)


# The density of Student's t, integrated from 0 to |t| by Simpson's rule in 4,000 steps.
T_TEST_P = f"""{GROUPS}, pairs as (select * from (values ('Brand#4', 'Brand#1'), ('Brand#3', 'Brand#4'), ('Brand#3', 'Brand#1')) v(a, b)),
    tests as (
        select a, b, (x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2) * (1.0 / x.n + 1.0 / y.n)) as t,
               cast(x.n + y.n - 2 as double) as dof
        from pairs join g x on x.make = a join g y on y.make = b),
    points as (select *, unnest(generate_series(0, 4000)) as i from tests),
    area as (
        select a, b, t, dof, sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end
            * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - ln(dof * pi()) / 2 - (dof + 1) / 2 * ln(1 + pow(abs(t) * i / 4000, 2) / dof)))
            * abs(t) / 4000 / 3 as half
        from points group by a, b, t, dof)
    select a, b, round(t, 6) as t, dof, round(1 - 2 * half, 7) as p from area"""


@query("a7_t_test_p", T_TEST_P)
def t_test_p(spark, sf_dir):
    pairs = [("Brand#4", "Brand#1"), ("Brand#3", "Brand#4"), ("Brand#3", "Brand#1")]
    tests = A.with_p_values(A.ttest_pairs(listings(spark, sf_dir), "price", "make", pairs))
    return rounded(rounded(tests, "t", digits=6), "p", digits=7)


@query("a8_t_test_all_pairs", f"{GROUPS} {T_TEST} x.make < y.make where x.make in ({IN_TOP}) and y.make in ({IN_TOP})")
def t_test_all_pairs(spark, sf_dir):
    result = A.ttest_pairs(listings(spark, sf_dir), "price", "make", groups=TOP_MAKES)
    return rounded(result, "t", digits=6)


def _histogram_sql(source: str, value: str, group: str, n: int) -> str:
    return f"""r as (select cast(min({value}) as double) as a, cast(max({value}) as double) as z from {source}),
    h as (select {group} as g, cast(least(floor(({value} - a) / (z - a) * {n}), {n - 1}) as int) as bin, count(*) as c
          from {source}, r group by 1, 2),
    grid as (select g, cast(unnest(generate_series(0, {n - 1})) as int) as bin from (select distinct g from h)),
    filled as (select grid.g, grid.bin, a + grid.bin * ((z - a) / {n}) as lo, a + (grid.bin + 1) * ((z - a) / {n}) as hi,
                      coalesce(c, 0) as n_rows from grid left join h on grid.g = h.g and grid.bin = h.bin cross join r)"""


def _histogram(a: str, b: str, n: int) -> None:
    @query(
        f"a9_histogram_{n}",
        f"""{LISTINGS}, s as (select make, price from listings where make in ('{a}', '{b}')), {_histogram_sql('s', 'price', 'make', n)}
        select g as make, bin, round(lo, 4) as lo, round(hi, 4) as hi, n_rows from filled""",
    )
    def histogram(spark, sf_dir):
        return rounded(A.histogram(listings(spark, sf_dir), "price", n, "make", [a, b]), "lo", "hi")


for _a, _b, _n in (("Brand#1", "Brand#2", 20), ("Brand#3", "Brand#4", 10), ("Brand#1", "Brand#2", 500), ("Brand#3", "Brand#4", 50)):
    _histogram(_a, _b, _n)


@query(
    "a10_density",
    f"""{LISTINGS}, s as (select make, price from listings where make in ('Brand#1', 'Brand#2')), {_histogram_sql('s', 'price', 'make', 60)}
    select g as make, bin, round(lo, 4) as lo, round(hi, 4) as hi, n_rows,
           round(n_rows / (sum(n_rows) over (partition by g) * (hi - lo)), 12) as density from filled""",
)
def density(spark, sf_dir):
    result = A.density_histogram(listings(spark, sf_dir), "price", 60, "make", ["Brand#1", "Brand#2"])
    return rounded(rounded(result, "lo", "hi"), "density", digits=12)


@query(
    "a11_normal_curve",
    f"""{LISTINGS}, m as (select make, avg(price) as mu, stddev_samp(price) as sd, min(price) as a, max(price) as z from listings
        where make in ('Brand#1', 'Brand#2') group by 1),
    e as (select *, cast(unnest(generate_series(0, 60)) as int) as edge from m),
    x as (select *, a + edge * ((z - a) / 60) as x from e)
    select make, edge, round(x, 4) as x, round(exp(-0.5 * pow((x - mu) / sd, 2)) / (sqrt(2 * pi()) * sd), 12) as y from x""",
)
def normal_curve(spark, sf_dir):
    rows = C.one_of(listings(spark, sf_dir), "make", ["Brand#1", "Brand#2"])
    return rounded(rounded(A.normal_curve(rows, "price", 60, "make"), "x"), "y", digits=12)


@query(
    "a11_curve_on_histogram_edges",
    f"""{LISTINGS}, m as (select make, avg(price) as mu, stddev_samp(price) as sd from listings
        where make in ('Brand#1', 'Brand#2') group by 1),
    r as (select min(price) as a, max(price) as z from listings where make in ('Brand#1', 'Brand#2')),
    e as (select *, cast(unnest(generate_series(0, 60)) as int) as edge from m, r),
    x as (select *, a + edge * ((z - a) / 60) as x from e)
    select make, edge, round(x, 4) as x, round(exp(-0.5 * pow((x - mu) / sd, 2)) / (sqrt(2 * pi()) * sd), 12) as y from x""",
)
def curve_on_histogram_edges(spark, sf_dir):
    rows = C.one_of(listings(spark, sf_dir), "make", ["Brand#1", "Brand#2"])
    return rounded(rounded(A.normal_curve(rows, "price", 60, "make", common=True), "x"), "y", digits=12)


DRAWS = """m as (select avg(price) as mu, stddev_samp(price) as sd from s),
    u as (select listing_id, (cast(('0x' || substr(md5(concat(listing_id, ':10')), 1, 8)) as bigint) + 0.5::double) / 4294967296 as u1,
                 (cast(('0x' || substr(md5(concat(listing_id, ':10')), 9, 8)) as bigint) + 0.5::double) / 4294967296 as u2 from s),
    draws as (select listing_id, mu + sd * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)) as draw from u, m)"""
COMMON = f"{LISTINGS}, s as (select listing_id, price from listings where make in ('Brand#1', 'Brand#2'))"


@query("a12_normal_draws", f"{COMMON}, {DRAWS} select listing_id, round(draw, 4) as draw from draws")
def normal_draws(spark, sf_dir):
    rows = C.one_of(listings(spark, sf_dir), "make", ["Brand#1", "Brand#2"])
    return rounded(A.normal_draws(rows, "price", "listing_id"), "draw")


@query(
    "a12_density_of_draws",
    f"""{COMMON}, {DRAWS}, d as (select draw, 'all' as grp from draws), {_histogram_sql('d', 'draw', 'grp', 60)}
    select g as "group", bin, round(lo, 3) as lo, n_rows from filled""",
)
def density_of_draws(spark, sf_dir):
    rows = C.one_of(listings(spark, sf_dir), "make", ["Brand#1", "Brand#2"])
    result = A.density_histogram(A.normal_draws(rows, "price", "listing_id"), "draw")
    return rounded(result.select("group", "bin", "lo", "n_rows"), "lo", digits=3)


@query(
    "a13_scatter_bins",
    f"""{LISTINGS}, s as (select make, price from listings where make in ({IN_TOP})),
    r as (select min(price) as a, max(price) as z from s)
    select make, cast(least(floor((price - a) / (z - a) * 100), 99) as int) as bin, count(*) as n_rows from s, r group by 1, 2""",
)
def scatter_bins(spark, sf_dir):
    return A.scatter_bins(listings(spark, sf_dir), "make", "price", 100, TOP_MAKES)


# A prediction that both engines can write down: the price without the part that depends on the make.
PREDICTED = f"""{SIGNAL}, p as (select price, 30000 + 1000 * (year - 1995) - 150 * mileage as prediction from price_signal)"""


def _predicted(spark, sf_dir):
    return price_signal(spark, sf_dir).select(
        "price", F.expr("30000 + 1000 * (year - 1995) - 150 * mileage").alias("prediction")
    )


METRICS_SQL = """select count(*) as n, round(avg(pow(price - prediction, 2)), 2) as mse,
    round(sqrt(avg(pow(price - prediction, 2))), 4) as rmse,
    round(1 - sum(pow(price - prediction, 2)) / (select sum(pow(price - (select avg(price) from p), 2)) from p), 8) as r2,
    round((select {base}(price) from p), 4) as baseline,
    round((select sqrt(avg(pow(price - (select {base}(price) from p), 2))) from p), 4) as base_rmse,
    round(sqrt(avg(pow(price - prediction, 2))) / (select sqrt(avg(pow(price - (select {base}(price) from p), 2))) from p), 8) as rmse_ratio
    from p"""


def rounded_metrics(df: DataFrame) -> DataFrame:
    df = rounded(rounded(df, "mse", digits=2), "rmse", "baseline", "base_rmse")
    return rounded(df, "r2", "rmse_ratio", digits=8)


@query("a14_evaluate_median", f"{PREDICTED} {METRICS_SQL.format(base='median')}")
def evaluate_median(spark, sf_dir):
    return rounded_metrics(evaluate(_predicted(spark, sf_dir)))


@query("a14_evaluate_mean", f"{PREDICTED} {METRICS_SQL.format(base='avg')}")
def evaluate_mean(spark, sf_dir):
    return rounded_metrics(evaluate(_predicted(spark, sf_dir), baseline="mean"))


@query(
    "a15_min_max",
    f"{LISTINGS} select min(mileage) as min_mileage, min(2020 - year) as min_age, max(mileage) as max_mileage, max(2020 - year) as max_age from listings",
)
def min_max(spark, sf_dir):
    return A.min_max(C.with_age(listings(spark, sf_dir)), ["mileage", "age"])


@query(
    "m11_r2",
    f"""{PREDICTED} select round(1 - sum(pow(price - prediction, 2)) /
        (select sum(pow(price - (select avg(price) from p), 2)) from p), 8) as r2 from p""",
)
def r2(spark, sf_dir):
    return rounded(r2_score(_predicted(spark, sf_dir)), "r2", digits=8)


@query(
    "m13_constant_baseline",
    f"""{SIGNAL} select listing_id, price, round((select median(price) from price_signal), 6) as prediction from price_signal""",
)
def constant_baseline(spark, sf_dir):
    rows = price_signal(spark, sf_dir).select("listing_id", "price")
    return rounded(constant_predictions(rows, "price"), "prediction", digits=6)


@query(
    "g1_sort_by_weight",
    f"{LISTINGS} select model as feature, round(avg(price), 4) as weight from listings group by 1",
)
def sort_by_weight(spark, sf_dir):
    from lotbook.operators.sampling import sort_by_weight as by_weight

    weights = listings(spark, sf_dir).groupBy(F.col("model").alias("feature")).agg(F.avg("price").alias("weight"))
    return by_weight(rounded(weights, "weight"))


@query(
    "g6_top_cities",
    f"{LISTINGS} select city, count(*) as n_rows from listings group by 1 order by n_rows desc, city limit 5",
)
def top_cities(spark, sf_dir):
    return A.value_counts(listings(spark, sf_dir), "city", 5)


def _normal_sample(segment: str, n: int) -> None:
    """As many draws as asked for, from the mean and deviation of a segment; n is that of the two published charts."""
    makes = ", ".join(f"'{m}'" for m in SEGMENTS[segment])

    @query(
        f"a12_{n}_draws_of_{segment}",
        f"""{LISTINGS}, m as (select avg(price) as mu, stddev_samp(price) as sd from listings where make in ({makes})),
        i as (select unnest(range({n})) as draw_id),
        u as (select draw_id, (cast(('0x' || substr(md5(concat(draw_id, ':10')), 1, 8)) as bigint) + 0.5::double) / 4294967296 as u1,
                     (cast(('0x' || substr(md5(concat(draw_id, ':10')), 9, 8)) as bigint) + 0.5::double) / 4294967296 as u2 from i)
        select draw_id, round(mu + sd * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)), 4) as draw from u, m""",
    )
    def draws(spark, sf_dir):
        rows = C.one_of(listings(spark, sf_dir), "make", SEGMENTS[segment])
        return rounded(A.normal_sample(rows, "price", n), "draw")


_normal_sample("common", 889)
_normal_sample("lux", 786)

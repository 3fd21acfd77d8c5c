"""Shuffles, samples, splits, feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries.cleaning import DIRTY, LISTINGS
from checks.queries.statistics import SIGNAL
from checks.registry import query
from checks.views import listings, listings_dirty, price_signal
from lotbook.operators import features as X
from lotbook.operators import sampling as G

DIGEST = "md5(concat(listing_id, ':10'))"


@query("g2_shuffle", f"{LISTINGS} select listing_id, price, {DIGEST} as shuffle_key from listings")
def shuffle(spark, sf_dir):
    return G.shuffle_rows(listings(spark, sf_dir).select("listing_id", "price"), "listing_id")


@query("g3_sample_50000", f"{LISTINGS} select listing_id, make, price from listings order by {DIGEST} limit 50000")
def sample_50000(spark, sf_dir):
    return G.sample_n(listings(spark, sf_dir).select("listing_id", "make", "price"), 50_000, "listing_id")


@query("g3_sample_777", f"{LISTINGS} select listing_id, make, price from listings order by {DIGEST} limit 777")
def sample_777(spark, sf_dir):
    return G.sample_n(listings(spark, sf_dir).select("listing_id", "make", "price"), 777, "listing_id")


def _split(name: str, share: float, limit: str) -> None:
    @query(
        name,
        f"{SIGNAL} select listing_id, price, case when {DIGEST} < '{limit}' then 'test' else 'train' end as part from price_signal",
    )
    def both_parts(spark, sf_dir):
        train, test = G.split(price_signal(spark, sf_dir).select("listing_id", "price"), share, "listing_id")
        return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


_split("g4_split_20", 0.2, "3" * 32)
_split("g4_split_10", 0.1, "1" + "9" * 31)


@query(
    "g4_split_exact",
    f"""{SIGNAL}, n as (select row_number() over (order by {DIGEST}) as place, count(*) over () as total, * from price_signal)
    select listing_id, price, case when place <= ceil(total * 0.1) then 'test' else 'train' end as part from n""",
)
def split_exact(spark, sf_dir):
    rows = price_signal(spark, sf_dir).select("listing_id", "price")
    train, test = G.split(rows, 0.1, "listing_id", exact=True)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("g5_first_20000", f"{LISTINGS} select listing_id, price from listings order by listing_id limit 20000")
def first_20000(spark, sf_dir):
    return G.first_n(listings(spark, sf_dir).select("listing_id", "price"), 20_000, "listing_id")


def _one_hot_sql(column: str, values: list[str]) -> str:
    dummies = [f"case when {column} = '{v}' then 1 else 0 end as \"{column}_{v}\"" for v in values]
    return ", ".join([*dummies, f"case when {column} is null then 1 else 0 end as {column}_nan"])


@query(
    "f1_one_hot",
    f"""{DIRTY} select price, mileage, {_one_hot_sql('color', ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])},
    {_one_hot_sql('state', ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'])} from listings_dirty""",
)
def one_hot(spark, sf_dir):
    return X.one_hot(listings_dirty(spark, sf_dir).select("price", "mileage", "color", "state"))


TEXTS = ("make", "model", "body_style", "city", "state", "color")


def _one_hot_sums_sql(column: str) -> str:
    return f"""select concat('{column}_', {column}) as feature, count(*) as n_rows from listings_dirty where {column} is not null group by 1
    union all select '{column}_nan', count(*) from listings_dirty where {column} is null"""


@query("f1_one_hot_all_columns", f"{DIRTY} {' union all '.join(map(_one_hot_sums_sql, TEXTS))}")
def one_hot_all_columns(spark, sf_dir):
    """How many rows have a one in each column, over all six text columns."""
    dummies = X.one_hot(listings_dirty(spark, sf_dir).select(*TEXTS))
    sums = dummies.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in dummies.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("n_rows")) for c in dummies.columns])
    return sums.select(F.inline(entries))


@query(
    "f2_min_max_scale",
    f"""{LISTINGS}, r as (select min(mileage) as m0, max(mileage) as m1, min(year) as y0, max(year) as y1 from listings)
    select listing_id, round((mileage - m0) / (m1 - m0), 10) as mileage, round((year - y0) / cast(y1 - y0 as double), 10) as year,
           0.0 as fixed from listings, r""",
)
def min_max_scale(spark, sf_dir):
    rows = listings(spark, sf_dir).select("listing_id", "mileage", "year", F.lit(3.0).alias("fixed"))
    scaled = X.min_max_scale(rows, ["mileage", "year", "fixed"])
    return scaled.withColumns({c: F.round(c, 10) for c in ("mileage", "year")})


@query(
    "f4_bands_fixed_edges",
    f"""{SIGNAL} select listing_id, cast(case when price < 25000 then 0 when price < 30000 then 1 when price < 35000 then 2 else 3 end as double) as band
    from price_signal""",
)
def bands_fixed(spark, sf_dir):
    banded, _ = X.price_bands(price_signal(spark, sf_dir), edges=[25000, 30000, 35000])
    return banded.select("listing_id", "band")


@query(
    "f4_bands_equal_share",
    f"""{SIGNAL}, q as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.5) as b, quantile_cont(price, 0.75) as c from price_signal)
    select cast(case when price < a then 0 when price < b then 1 when price < c then 2 else 3 end as double) as band, count(*) as n_rows
    from price_signal, q group by 1""",
)
def bands_equal(spark, sf_dir):
    banded, _ = X.price_bands(price_signal(spark, sf_dir), n=4)
    return banded.groupBy("band").agg(F.count("*").alias("n_rows"))

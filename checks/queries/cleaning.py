"""Projection, filters, cleaning and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries.sources import COLUMNS, WORKLIST
from checks.registry import query
from checks.views import LISTING_COLUMNS, listings, listings_dirty, oracle_views, price_signal, view
from lotbook.operators import clean as C
from lotbook.operators.combine import union_outer, union_same
from lotbook.operators.rows import with_row_id
from lotbook.operators.sampling import first_n, shuffle_rows
from lotbook.schemas import LISTINGS_RAW
from lotbook.session import scratch_path
from lotbook.sources.worklist import crawl_worklist, in_range, shard_number

TOP_MAKES = [f"Brand#{i}" for i in range(1, 11)]
SEGMENTS = {"common": ["Brand#1", "Brand#2"], "lux": ["Brand#3", "Brand#4"]}

LISTINGS = f"with {oracle_views('listings')}"
DIRTY = f"with {oracle_views('listings_dirty')}"
COMPLETE = "price is not null and color is not null"
IN_TOP = ", ".join(f"'{m}'" for m in TOP_MAKES)
SEGMENT_CASE = "case when make in ('Brand#1', 'Brand#2') then 'common' when make in ('Brand#3', 'Brand#4') then 'lux' end"


@query(
    "c1_positional_projection",
    f"""with {oracle_views('raw_positional')}
    select c0 as price, c1 as make, c2 as model, c3 as year, c4 as body_style, c6 as city, c7 as state, c8 as mileage,
           c9 as seller_type, c10 as seller_rating, c11 as review_count from raw_positional""",
)
def positional_projection(spark, sf_dir):
    return C.project_positional(view(spark, sf_dir, "raw_positional"))


@query("c2_equal_make", f"{LISTINGS} select listing_id, make, price from listings where make = 'Brand#7'")
def equal_make(spark, sf_dir):
    return C.equal_to(listings(spark, sf_dir), "make", "Brand#7").select("listing_id", "make", "price")


@query("c3_top_ten_makes", f"{LISTINGS} select listing_id, make, price from listings where make in ({IN_TOP})")
def top_ten(spark, sf_dir):
    return C.one_of(listings(spark, sf_dir), "make", TOP_MAKES).select("listing_id", "make", "price")


@query("c4_drop_incomplete", f"{DIRTY} select {COLUMNS} from listings_dirty where {COMPLETE}")
def drop_incomplete(spark, sf_dir):
    return C.drop_incomplete(listings_dirty(spark, sf_dir))


@query("c5_drop_repeats", f"{DIRTY} select distinct {COLUMNS} from listings_dirty")
def drop_repeats(spark, sf_dir):
    return C.drop_repeats(listings_dirty(spark, sf_dir))


@query(
    "c6_stage_counts",
    f"""{DIRTY}, d as (select distinct * from listings_dirty)
    select 0 as step, 'all_rows' as stage, count(*) as n_rows from listings_dirty
    union all select 1, 'no_repeats', count(*) from d
    union all select 2, 'complete', count(*) from d where {COMPLETE}""",
)
def stage_counts(spark, sf_dir):
    return C.stage_counts(listings_dirty(spark, sf_dir))


@query(
    "c7_age",
    f"""{LISTINGS} select price, make, model, body_style, city, state, mileage, color, cast(2020 - year as int) as age from listings""",
)
def age(spark, sf_dir):
    return C.with_age(listings(spark, sf_dir).select(*LISTING_COLUMNS))


@query("c8_without_label", f"{LISTINGS} select make, model, year, body_style, city, state, mileage, color from listings")
def without_label(spark, sf_dir):
    return C.split_label(listings(spark, sf_dir).select(*LISTING_COLUMNS))[0]


@query("c8_label", f"{LISTINGS} select price from listings")
def label(spark, sf_dir):
    return C.split_label(listings(spark, sf_dir))[1]


@query("c9_text_columns", f"{LISTINGS} select make, model, body_style, city, state, color from listings")
def text_columns(spark, sf_dir):
    rows = listings(spark, sf_dir).select(*LISTING_COLUMNS)
    return rows.select(*C.columns_of_type(rows))


def _as_text(spark, sf_dir):
    rows = listings_dirty(spark, sf_dir)
    return rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])


@query("c11_tighten_types", f"{DIRTY} select {COLUMNS} from listings_dirty")
def tighten_types(spark, sf_dir):
    """All columns given as text; the numbers are found again."""
    return C.tighten_types(_as_text(spark, sf_dir))


@query(
    "c11_tighten_doubles",
    f"{DIRTY} select price, cast(mileage as bigint) as mileage, make from listings_dirty",
)
def tighten_doubles(spark, sf_dir):
    return C.tighten_types(listings_dirty(spark, sf_dir).select("price", "mileage", "make"))


@query(
    "c10_schema_table",
    f"""{DIRTY}, t as (select cast(price as varchar) as price, make, cast(year as varchar) as year, cast(mileage as varchar) as mileage from listings_dirty)
    select * from (
        select 'price' as "column", case when bool_and(try_cast(price as double) is not null or price is null) then 'double' else 'string' end as type from t
        union all select 'make', case when bool_and(try_cast(make as double) is not null or make is null) then 'double' else 'string' end from t
        union all select 'year', case when bool_and(regexp_matches(year, '^[0-9]+$') or year is null) then 'bigint' else 'double' end from t
        union all select 'mileage', case when bool_and(regexp_matches(mileage, '^[0-9]+$') or mileage is null) then 'bigint' else 'double' end from t)""",
)
def schema_table(spark, sf_dir):
    """The types that the values of the whole table allow."""
    return C.schema_table(C.tighten_types(_as_text(spark, sf_dir).select("price", "make", "year", "mileage")))


@query("c12_strict_int", f"{LISTINGS} select listing_id, year from listings")
def strict_int(spark, sf_dir):
    rows = listings(spark, sf_dir).select("listing_id", F.col("year").cast("string").alias("year"))
    return C.whole_number(rows, "year")


@query("c13_range", f"with {oracle_views('zips')} select zip from zips where zip >= 14500 and zip < 19000")
def zip_range(spark, sf_dir):
    return view(spark, sf_dir, "zips").where(in_range(F.col("zip"), 14500, 19000))


@query(
    "c14_shard_number",
    f"""with {oracle_views('zips')} select cast(floor((zip - 10000) / 4500.0) + 1 as int) as shard, count(*) as n_zips
    from zips where zip >= 10000 and zip < 100000 group by 1""",
)
def shards(spark, sf_dir):
    zips = view(spark, sf_dir, "zips").where(in_range(F.col("zip"), 10000, 100000))
    return zips.groupBy(shard_number(F.col("zip")).alias("shard")).agg(F.count("*").alias("n_zips"))


@query("c15_columns", f"{LISTINGS} select mileage, year from listings")
def columns(spark, sf_dir):
    return listings(spark, sf_dir).select("mileage", "year")


@query("c16_first_rows", f"{LISTINGS} select * from listings order by listing_id limit 8")
def first_rows(spark, sf_dir):
    return first_n(listings(spark, sf_dir), 8, "listing_id")


@query("c17_segments", f"{LISTINGS} select listing_id, price, {SEGMENT_CASE} as segment from listings")
def segments(spark, sf_dir):
    return C.with_segment(listings(spark, sf_dir), SEGMENTS).select("listing_id", "price", "segment")


@query(
    "c18_renumber",
    f"""{LISTINGS} select row_number() over (order by md5(concat(listing_id, ':10'))) - 1 as row_id, listing_id, price from listings""",
)
def renumber(spark, sf_dir):
    """Dense numbers in shuffled order."""
    shuffled = shuffle_rows(listings(spark, sf_dir).select("listing_id", "price"), "listing_id")
    return with_row_id(shuffled, "shuffle_key").drop("shuffle_key")


@query("u1_union_same", f"{LISTINGS} select {COLUMNS} from listings")
def union_of_shards(spark, sf_dir):
    """Twenty tables of the same columns."""
    root = scratch_path(spark, "union")
    rows = listings(spark, sf_dir).select(*LISTING_COLUMNS, F.pmod(F.xxhash64("listing_id"), F.lit(20)).alias("shard"))
    rows.write.partitionBy("shard").parquet(root)
    return union_same([spark.read.schema(LISTINGS_RAW).parquet(f"{root}/shard={k}") for k in range(20)])


@query(
    "u2_union_outer",
    f"""{LISTINGS} select body_style, city, cast(null as varchar) as color, make, mileage, model, price, state, year from listings
    union all select body_style, city, color, make, mileage, model, price, state, year from listings""",
)
def union_of_batches(spark, sf_dir):
    rows = listings(spark, sf_dir).select(*LISTING_COLUMNS)
    return union_outer([rows.drop("color"), rows], sort_columns=True)


@query("u3_zip_by_page", f"select zip, page_num from ({WORKLIST}) w")
def zip_by_page(spark, sf_dir):
    return crawl_worklist(view(spark, sf_dir, "zips")).select("zip", "page_num")


@query(
    "e2_prepared_table",
    f"""with {oracle_views('listings_dirty')},
    d as (select distinct price, make, model, body_style, city, state, mileage, color, 2020 - year as age from listings_dirty
          where {COMPLETE}),
    r as (select min(mileage) as m0, max(mileage) as m1, min(age) as a0, max(age) as a1 from d)
    select price, make, model, body_style, city, state, color, (mileage - m0) / (m1 - m0) as mileage,
           (age - a0) / cast(a1 - a0 as double) as age from d, r""",
)
def prepared_table(spark, sf_dir):
    """The whole preparation: distinct, complete, age instead of year, scaled."""
    from lotbook.plans.prepare import prepare

    return prepare([listings_dirty(spark, sf_dir)])


@query(
    "e2_price_signal_summary",
    f"with {oracle_views('price_signal')} select count(*) as n, min(price) as lo, max(price) as hi from price_signal",
)
def signal_summary(spark, sf_dir):
    return price_signal(spark, sf_dir).agg(
        F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi")
    )

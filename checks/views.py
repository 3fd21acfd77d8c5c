"""Test tables derived from the given parquet tables.

Views written as SQL run unchanged in Spark and in DuckDB, so the oracle can inline them.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE_TABLES = ("lineitem", "orders", "part", "customer", "nation", "region")
PER_PAGE = 100

SQL = {
    "listings": """
        select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
                         cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string))
                 as listing_id,
               l_extendedprice as price, p_brand as make, p_name as model, cast(year(o_orderdate) as int) as year,
               p_type as body_style, n_name as city, r_name as state, l_quantity as mileage, c_mktsegment as color
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
             join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
             join {region} on n_regionkey = r_regionkey""",
    "listings_dirty": """
        select case when length(model) % 5 = 0 and mileage > 45 then null else price end as price, make, model, year,
               body_style, city, state, mileage, case when mileage = 13 then null else color end as color
        from {listings}
        union all
        select case when length(model) % 5 = 0 and mileage > 45 then null else price end as price, make, model, year,
               body_style, city, state, mileage, case when mileage = 13 then null else color end as color
        from {listings} where mileage <= 5""",
    "price_signal": """
        select 20000 + 800 * cast(substr(make, 7) as int) + 1000 * (year - 1995) - 150 * mileage + 0.05 * price as price,
               make, model, year, body_style, city, state, mileage, color, listing_id
        from {listings}""",
    "zips": """
        select distinct cast(5000 + (o_orderkey * 37) % 99000 as int) as zip from {orders}""",
    "raw_positional": """
        select l_extendedprice as c0, p_brand as c1, p_name as c2, cast(year(o_orderdate) as int) as c3, p_type as c4,
               o_orderstatus as c5, n_name as c6, r_name as c7, l_quantity as c8, c_mktsegment as c9, l_discount as c10,
               l_linenumber as c11
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
             join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
             join {region} on n_regionkey = r_regionkey""",
}
NEEDS = {"listings_dirty": "listings", "price_signal": "listings"}
LISTING_COLUMNS = ["price", "make", "model", "year", "body_style", "city", "state", "mileage", "color"]


@cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in BASE_TABLES if f"{{{t}}}" in SQL[name]}
    if name in NEEDS:
        frames[NEEDS[name]] = view(spark, sf_dir, NEEDS[name])
    return spark.sql(SQL[name], **frames)


def oracle_views(*names: str) -> str:
    """The views as a WITH clause (without the word WITH) for DuckDB."""
    wanted: list[str] = []
    for name in names:
        for one in (NEEDS.get(name), name):
            if one and one not in wanted:
                wanted.append(one)
    plain = {t: t for t in (*BASE_TABLES, *SQL)}
    return ",\n".join(f"{name} as ({SQL[name].format(**plain)})" for name in wanted)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "listings")


def listings_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``SQL["listings_dirty"]``. Its two halves are one join here, whose rows are doubled in place."""
    rows = listings(spark, sf_dir)
    dirty = {
        "price": F.when((F.length("model") % 5 == 0) & (F.col("mileage") > 45), None).otherwise(F.col("price")),
        "color": F.when(F.col("mileage") == 13, None).otherwise(F.col("color")),
    }
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("mileage") <= 5, 2).otherwise(1)))
    return rows.select(*[dirty.get(c, F.col(c)).alias(c) for c in LISTING_COLUMNS], copies.alias("_copy")).drop("_copy")


def price_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "price_signal")


# --- pages -----------------------------------------------------------------------------------------

PAGE_HEAD = '<html><script type="application/ld+json">[{"@context":"http://schema.org",'
PAGE_CONTEXT = '{"@context":"http://schema.org"'
PAGE_MIDDLE = '}]</script><p>skip "type":"inventory"</p><script>var d=['
PAGE_END = "];</script></html>"


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _color_piece(color: Column) -> Column:
    return _joined('"url":"http://x/","color":"', color, '"},')


def _listing_piece(c: dict[str, Column]) -> Column:
    """One listing of the page's data block; a null column leaves its key out (or, for mileage, closes
    it with another key, since the price ends where mileage begins)."""

    def optional(value: Column, *around: str | Column) -> Column:
        return F.when(value.isNotNull(), _joined(*around)).otherwise("")

    return _joined(
        '{"type":"inventory",',
        optional(c["make"], '"make":"', c["make"], '","makeId":1,'),
        optional(c["model"], '"model":"', c["model"], '","modelId":2,'),
        optional(c["year"], '"year":', c["year"], ',"trim":"x",'),
        optional(c["body_style"], '"bodyStyle":"', c["body_style"], '","customerId":3,'),
        '"rating":4.5,"reviewCount":7',
        optional(c["city"], ',"city":"', c["city"], '"'),
        optional(c["state"], ',"state":"', c["state"], '","truncatedDescription":""'),
        optional(c["price"], ',"price":', c["price"]),
        F.when(c["mileage"].isNotNull(), _joined(',"mileage":', c["mileage"], ',"vin":"v"}')).otherwise(
            ',"mileage":"","lot":"v"}'
        ),
    )


def pages_from(rows: DataFrame, bare: Column | None = None, cut: Column | None = None) -> DataFrame:
    """page_id, html from page_id, listing_id, copy and the listing columns.

    An order with many listings is spread over pages of about a hundred. ``bare`` pages lack their
    script elements, ``cut`` pages lack the text that ends their last colour.
    """
    # the listings meet once, as columns; counting them and the text of a page both follow without another exchange
    on_page = Window.partitionBy("page_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = rows.withColumn("_pages", F.ceil(F.count("*").over(on_page) / PER_PAGE))
    cells = F.struct("listing_id", "copy", *LISTING_COLUMNS)
    gathered = (
        counted.where("page_id is not null")
        .groupBy("page_id", F.pmod(F.xxhash64("listing_id"), F.col("_pages")).alias("_page"))
        .agg(F.collect_list(cells).alias("p"))
    )
    gathered = gathered.withColumn("p", F.sort_array(F.transform("p", lambda c: F.struct(
        c["listing_id"], c["copy"], _color_piece(c["color"]).alias("color"),
        _listing_piece({name: c[name] for name in LISTING_COLUMNS}).alias("listing"),
    ))))
    context = F.lit(PAGE_CONTEXT)
    colors = F.array_join(F.col("p.color"), PAGE_CONTEXT + ",")
    if cut is not None:
        context = F.when(cut, F.lit('{"closed":"yes"')).otherwise(context)
    html = F.concat(
        F.lit(PAGE_HEAD), colors, context, F.lit(PAGE_MIDDLE), F.array_join(F.col("p.listing"), ","), F.lit(PAGE_END)
    )
    if bare is not None:
        html = F.when(bare, F.replace(F.replace(html, F.lit("<script"), F.lit("<div")), F.lit("</script>"), F.lit("</div>"))).otherwise(html)
    return gathered.select("page_id", html.alias("html"))


def with_page_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("page_id", F.split_part("listing_id", F.lit("-"), F.lit(1)).cast("bigint"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_from(with_page_id(listings(spark, sf_dir)).withColumn("copy", F.lit(1)))


# Mileages whose listings are damaged, and how.
NO_MODEL, NO_PRICE, NO_MILEAGE, COMMA_CITY, TWICE, NOTHING, NO_PRICE_MAKE, APOSTROPHE = 13, 14, 15, 16, 17, 18, 19, 20
CUT_EVERY, BARE_EVERY = 7, 11


def damaged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_page_id(listings(spark, sf_dir)).withColumn("kind", F.col("mileage").cast("int"))
    kind = F.col("kind")
    gone = {
        "model": (NO_MODEL, NOTHING), "price": (NO_PRICE, NOTHING, NO_PRICE_MAKE),
        "mileage": (NO_MILEAGE, NOTHING), "make": (NOTHING, NO_PRICE_MAKE),
        "year": (NOTHING,), "body_style": (NOTHING,), "city": (NOTHING,), "state": (NOTHING,),
    }
    values = {c: F.when(~kind.isin(*kinds), F.col(c).cast("string")) for c, kinds in gone.items()}
    values["city"] = F.when(kind == COMMA_CITY, F.concat("city", F.lit(", East"))).otherwise(values["city"])
    values["make"] = F.when(kind == APOSTROPHE, F.concat(F.lit("O'"), F.col("make"))).otherwise(values["make"])
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == TWICE, 2).otherwise(1))).alias("copy")
    return rows.withColumns(values).select("*", copies)


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_from(
        damaged_rows(spark, sf_dir), F.col("page_id") % BARE_EVERY == 0, F.col("page_id") % CUT_EVERY == 0
    )


# The same pages, undamaged, as text in DuckDB.
ORACLE_PAGES = f"""
listing_pages as (
    select cast(split_part(listing_id, '-', 1) as bigint) as page_id,
           concat('{PAGE_HEAD}',
             string_agg(concat('"url":"http://x/","color":"', color, '"}},'), '{PAGE_CONTEXT},' order by listing_id),
             '{PAGE_CONTEXT}', '{PAGE_MIDDLE}',
             string_agg(concat('{{"type":"inventory","make":"', make, '","makeId":1,"model":"', model,
               '","modelId":2,"year":', year, ',"trim":"x","bodyStyle":"', body_style,
               '","customerId":3,"rating":4.5,"reviewCount":7,"city":"', city, '","state":"', state,
               '","truncatedDescription":"","price":', price, ',"mileage":', mileage, ',"vin":"v"}}'), ',' order by listing_id),
             '{PAGE_END}') as html
    from listings group by 1)"""

# What the damaged pages hold, listing by listing, with the reason why it gives no row.
ORACLE_DAMAGED = f"""
copies as (
    select *, cast(split_part(listing_id, '-', 1) as bigint) as page_id, unnest(generate_series(1, case when mileage = {TWICE} then 2 else 1 end)) as copy
    from listings),
placed as (
    select *, cast(row_number() over (partition by page_id order by listing_id, copy) - 1 as int) as pos,
           count(*) over (partition by page_id) as on_page
    from copies),
cells as (
    select page_id, pos, on_page, color, mileage as kind,
           case when mileage not in ({NO_PRICE}, {NOTHING}, {NO_PRICE_MAKE}) then cast(price as varchar) end as price,
           case when mileage = {APOSTROPHE} then concat('O', make)
                when mileage not in ({NOTHING}, {NO_PRICE_MAKE}) then make end as make,
           case when mileage not in ({NO_MODEL}, {NOTHING}) then model end as model,
           case when mileage <> {NOTHING} then cast(year as varchar) end as year,
           case when mileage <> {NOTHING} then body_style end as body_style,
           case when mileage = {COMMA_CITY} then concat(city, ', East') when mileage <> {NOTHING} then city end as city,
           case when mileage <> {NOTHING} then state end as state,
           case when mileage not in ({NO_MILEAGE}, {NOTHING}) then cast(mileage as varchar) end as mileage
    from placed),
judged as (
    select *, concat(coalesce(price, ''), ',', coalesce(make, ''), ',', coalesce(model, ''), ',', coalesce(year, ''), ',',
                     coalesce(body_style, ''), ',', coalesce(city, ''), ',', coalesce(state, ''), ',',
                     coalesce(mileage, ''), ',', color) as line,
           case when page_id % {CUT_EVERY} = 0 and pos = on_page - 1 then 'no colour at this position'
                when kind = {NOTHING} then 'all fields missing'
                when kind = {NO_MODEL} then 'missing field between present fields'
                when kind = {COMMA_CITY} then 'wrong number of commas' end as reason
    from cells where page_id % {BARE_EVERY} <> 0)"""

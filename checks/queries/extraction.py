"""Page text to listing rows."""

from __future__ import annotations

from checks.registry import query
from checks.views import (
    LISTING_COLUMNS,
    ORACLE_DAMAGED,
    ORACLE_PAGES,
    damaged_pages,
    listing_pages,
    oracle_views,
    table,
)
from lotbook.functions.text import FIELD_PATTERNS, UNUSED_FIELD_PATTERNS
from lotbook.operators import extract as E

PAGES = f"with {oracle_views('listings')}, {ORACLE_PAGES}"
SCRIPTS = rf"""{PAGES}, scripts as (
    select page_id, array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script>'), ', ') as script
    from listing_pages)"""
FRAGMENTS = f"""{SCRIPTS}, fragments as (
    select page_id, unnest(list_filter(string_split(script, '"type"'), lambda x: starts_with(x, ':"inventory"'))) as fragment,
           generate_subscripts(list_filter(string_split(script, '"type"'), lambda x: starts_with(x, ':"inventory"')), 1) - 1 as pos
    from scripts)"""
COLORS = rf"""{SCRIPTS}, colors as (
    select page_id, unnest(regexp_extract_all(script, '/","color":"(.*?)"\}},\{{"@context":"http://schema\.org"', 1)) as color,
           generate_subscripts(regexp_extract_all(script, '/","color":"(.*?)"\}},\{{"@context":"http://schema\.org"', 1), 1) - 1 as pos
    from scripts)"""
DAMAGED = f"with {oracle_views('listings')}, {ORACLE_DAMAGED}"
TYPED = """try_cast(price as double) as price, nullif(make, '') as make, model, cast(year as int) as year, body_style, city, state,
    try_cast(mileage as double) as mileage, color"""


@query(
    "x1_script_blocks",
    r"""select page_id, array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script>'), ', ') as script from pages""",
)
def script_blocks(spark, sf_dir):
    return E.with_script(table(spark, sf_dir, "pages")).select("page_id", "script")


def _scripts(spark, sf_dir):
    return E.with_script(listing_pages(spark, sf_dir))


@query(
    "x2_split_fragments",
    f"""{SCRIPTS} select page_id, unnest(string_split(script, '"type"')) as fragment,
        generate_subscripts(string_split(script, '"type"'), 1) - 1 as pos from scripts""",
)
def split_fragments(spark, sf_dir):
    return E.split_fragments(_scripts(spark, sf_dir))


@query("x3_inventory_fragments", f"{FRAGMENTS} select page_id, pos, fragment from fragments")
def inventory_fragments(spark, sf_dir):
    return E.inventory_fragments(_scripts(spark, sf_dir))


@query(
    "x4_fields",
    f"""{FRAGMENTS} select page_id, pos,
        regexp_extract(fragment, ',"price":(.+),"mileage":', 1) as price, regexp_extract(fragment, '"make":"(.+)","makeId"', 1) as make,
        regexp_extract(fragment, '"model":"(.+)","modelId"', 1) as model, regexp_extract(fragment, '"year":(.+),"trim"', 1) as year,
        regexp_extract(fragment, '"bodyStyle":"(.+)","customerId"', 1) as body_style,
        regexp_extract(fragment, '"city":"(.+),"state":', 1) as city,
        regexp_extract(fragment, ',"state":"(.+)","truncatedDescription', 1) as state,
        regexp_extract(fragment, ',"mileage":(.+),"vin":', 1) as mileage,
        regexp_extract(fragment, ',"rating":(.+),"reviewCount"', 1) as seller_rating,
        regexp_extract(fragment, '"rating":(.+),"review', 1) as rating,
        cast(null as varchar) as color from fragments""",
)
def fields(spark, sf_dir):
    return E.extract_fields(
        E.inventory_fragments(_scripts(spark, sf_dir)), {**FIELD_PATTERNS, **UNUSED_FIELD_PATTERNS}
    )


@query("x5_page_colors", f"{COLORS} select page_id, pos, color from colors")
def page_colors(spark, sf_dir):
    return E.colors(_scripts(spark, sf_dir))


@query(
    "x6_color_by_position",
    f"""{SCRIPTS}, found as (
        select page_id, list_filter(string_split(script, '"type"'), lambda x: starts_with(x, ':"inventory"')) as parts,
               regexp_extract_all(script, '/","color":"(.*?)"\\}},\\{{"@context":"http://schema\\.org"', 1) as colors
        from scripts)
    select page_id, cast(i - 1 as int) as pos, parts[i] as fragment, colors[i] as color
    from (select *, unnest(generate_series(1, least(len(parts), len(colors)))) as i from found)""",
)
def color_by_position(spark, sf_dir):
    return E.match_colors(_scripts(spark, sf_dir))


def _damaged_lines(spark, sf_dir):
    return E.listing_lines(E.match_colors(E.with_script(damaged_pages(spark, sf_dir))))


@query(
    "x7_lines",
    f"{DAMAGED} select page_id, pos, line from judged where reason is null or reason <> 'no colour at this position'",
)
def lines(spark, sf_dir):
    return _damaged_lines(spark, sf_dir).select("page_id", "pos", "line")


@query("x8_arity", f"{DAMAGED} select page_id, pos, line from judged where reason is null")
def arity(spark, sf_dir):
    return E.arity_filter(_damaged_lines(spark, sf_dir)).select("page_id", "pos", "line")


@query("x9_distinct_lines", f"{DAMAGED} select distinct page_id, line from judged where reason is null")
def distinct_lines(spark, sf_dir):
    return E.distinct_lines(E.arity_filter(_damaged_lines(spark, sf_dir)))


@query("x10_typed_rows", f"{DAMAGED} select distinct page_id, {TYPED} from judged where reason is null")
def typed_rows(spark, sf_dir):
    return E.extract_listings(damaged_pages(spark, sf_dir))


@query(
    "x11_rejects",
    f"""{DAMAGED} select page_id, pos, line, reason from (
            select page_id, pos, case when reason <> 'no colour at this position' then line end as line, reason from judged
            where reason is not null) r
        union all
        select distinct cast(split_part(listing_id, '-', 1) as bigint), null, null, 'no script block' from listings
        where cast(split_part(listing_id, '-', 1) as bigint) % 11 = 0""",
)
def rejects(spark, sf_dir):
    return E.extract_with_rejects(damaged_pages(spark, sf_dir))[1]


@query(
    "x_round_trip",
    f"""with {oracle_views('listings')} select cast(split_part(listing_id, '-', 1) as bigint) as page_id,
        {', '.join(LISTING_COLUMNS)} from listings""",
)
def round_trip(spark, sf_dir):
    """Pages made from listings give back the listings."""
    return E.extract_listings(listing_pages(spark, sf_dir))


@query(
    "x_harvest_given_pages",
    r"""select page_id, cast(null as int) as pos, cast(null as varchar) as line,
        case when len(regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script>')) = 0 then 'no script block'
             else 'no listing fragment' end as reason from pages""",
)
def harvest_given_pages(spark, sf_dir):
    """The given pages hold no listings; every page is accounted for."""
    return E.judged_lines(table(spark, sf_dir, "pages").select("page_id", "html"))


@query(
    "u4_positional_match",
    f"""{SCRIPTS}, found as (
        select page_id, list_filter(string_split(script, '"type"'), lambda x: starts_with(x, ':"inventory"')) as parts,
               regexp_extract_all(script, '/","color":"(.*?)"\\}},\\{{"@context":"http://schema\\.org"', 1) as colors
        from scripts)
    select page_id, cast(i - 1 as int) as pos, parts[i] as part, colors[i] as color
    from (select *, unnest(generate_series(1, least(len(parts), len(colors)))) as i from found)""",
)
def positional_match(spark, sf_dir):
    from lotbook.functions.text import listing_fragments, page_colors

    arrays = _scripts(spark, sf_dir).select(
        "page_id", listing_fragments("script").alias("parts"), page_colors("script").alias("colors")
    )
    return E.positional_match(arrays, "parts", "colors", "part", "color")

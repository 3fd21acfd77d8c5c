"""Hand-written pages: what is kept, what is left out, and why."""

import pytest
from pyspark.sql import functions as F

from checks.views import pages_from
from lotbook.operators.extract import (
    arity_filter,
    distinct_lines,
    extract_listings,
    extract_with_rejects,
    listing_lines,
    match_colors,
    with_script,
)

FULL = {
    "make": "Ford", "model": "Focus", "year": "2015", "body_style": "Hatchback", "city": "Albany",
    "state": "NY", "price": "9500", "mileage": "51000",
}


def fragment(**changes):
    v = {**FULL, **changes}
    parts = ['{"type":"inventory"']
    if v["make"] is not None:
        parts.append(f',"make":"{v["make"]}","makeId":1')
    if v["model"] is not None:
        parts.append(f',"model":"{v["model"]}","modelId":2')
    if v["year"] is not None:
        parts.append(f',"year":{v["year"]},"trim":"x"')
    if v["body_style"] is not None:
        parts.append(f',"bodyStyle":"{v["body_style"]}","customerId":3')
    parts.append(',"rating":4.5,"reviewCount":7')
    if v["city"] is not None:
        parts.append(f',"city":"{v["city"]}"')
    if v["state"] is not None:
        parts.append(f',"state":"{v["state"]}","truncatedDescription":""')
    elif v["city"] is not None:
        parts.append(',"state":null')  # the city ends where the state begins
    if v["price"] is not None:
        parts.append(f',"price":{v["price"]}')
    parts.append(f',"mileage":{v["mileage"]},"vin":"v"}}' if v["mileage"] is not None else ',"mileage":0,"lot":1}')
    return "".join(parts)


def page(fragments, colors=None, last_color_ends=True, script="script"):
    colors = ["Red"] * len(fragments) if colors is None else colors
    context = '{"@context":"http://schema.org"'
    items = [f'"url":"http://x/","color":"{c}"}},' for c in colors]
    head = context + "," + (context + ",").join(items) + (context if last_color_ends else '{"end":1')
    return (
        f"<html><{script} type='application/ld+json'>[{head}}}]</{script}><p>\"type\":\"inventory\"</p>"
        f"<{script}>var d=[{','.join(fragments)}];</{script}></html>"
    )


def run(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    good, bad = extract_with_rejects(df)
    return [r.asDict() for r in good.orderBy("page_id").collect()], [r.asDict() for r in bad.collect()]


def test_whole_row(spark):
    good, bad = run(spark, page([fragment()]))
    assert bad == []
    assert good == [{
        "page_id": 0, "price": 9500.0, "make": "Ford", "model": "Focus", "year": 2015, "body_style": "Hatchback",
        "city": "Albany", "state": "NY", "mileage": 51000.0, "color": "Red",
    }]


@pytest.mark.parametrize("missing", [["price"], ["mileage"], ["price", "make"], ["state", "mileage"], ["price", "mileage"]])
def test_missing_at_either_end_is_kept(spark, missing):
    good, bad = run(spark, page([fragment(**{m: None for m in missing})]))
    assert bad == [] and len(good) == 1
    assert {c for c, v in good[0].items() if v is None} == set(missing)


@pytest.mark.parametrize("missing", [["model"], ["make"], ["year", "city"], ["price", "model"]])
def test_missing_inside_is_rejected(spark, missing):
    good, bad = run(spark, page([fragment(**{m: None for m in missing})]))
    assert good == []
    assert [b["reason"] for b in bad] == ["missing field between present fields"]


def test_all_fields_missing(spark):
    _, bad = run(spark, page([fragment(**dict.fromkeys(FULL))]))
    assert [b["reason"] for b in bad] == ["all fields missing"]


def test_last_listing_without_colour(spark):
    good, bad = run(spark, page([fragment(), fragment(city="Troy")], last_color_ends=False))
    assert [g["city"] for g in good] == ["Albany"]
    assert [(b["pos"], b["reason"]) for b in bad] == [(1, "no colour at this position")]


def test_colours_follow_position(spark):
    good, _ = run(spark, page([fragment(city=c) for c in "ABC"], ["Red", "Blue", ""]))
    assert {(g["city"], g["color"]) for g in good} == {("A", "Red"), ("B", "Blue"), ("C", None)}


def test_repeats_on_one_page_and_on_two(spark):
    good, _ = run(spark, page([fragment(), fragment()]), page([fragment()]))
    assert [g["page_id"] for g in good] == [0, 1]


def test_comma_in_city(spark):
    good, bad = run(spark, page([fragment(city="Albany, North")]))
    assert good == [] and [b["reason"] for b in bad] == ["wrong number of commas"]


def test_comma_does_not_make_up_for_a_gap(spark):
    good, bad = run(spark, page([fragment(model=None, city="Albany, North")]))
    assert good == [] and [b["reason"] for b in bad] == ["missing field between present fields"]


def test_apostrophe_and_brackets_are_stripped(spark):
    good, _ = run(spark, page([fragment(make="O'Ford", model="[Focus]")]))
    assert (good[0]["make"], good[0]["model"]) == ("OFord", "Focus")


def test_field_found_twice(spark):
    good, bad = run(spark, page([fragment(model='A","modelId":2,\n"model":"B')]))
    assert good == [] and [b["reason"] for b in bad] == ["wrong number of commas"]


def test_only_a_line_feed_ends_a_line(spark):
    good, _ = run(spark, page([fragment(model="Focus SE")]))
    assert good[0]["model"] == "Focus SE"


def test_missing_words_become_null(spark):
    good, _ = run(spark, page([fragment(price="null", state="N/A")]))
    assert good[0]["price"] is None and good[0]["state"] is None


def test_text_outside_script_blocks(spark):
    good, bad = run(spark, page([fragment()], script="div"), "<html><script>var x = 1;</script></html>", "")
    assert good == []
    assert sorted((b["page_id"], b["reason"]) for b in bad) == [
        (0, "no script block"), (1, "no listing fragment"), (2, "no script block"),
    ]


def test_other_page_columns_are_kept(spark):
    df = spark.createDataFrame([(1, 12345, page([fragment()]))], "page_id bigint, zip int, html string")
    assert extract_listings(df).first()["zip"] == 12345


def test_extraction_neither_shuffles_nor_leaves_the_jvm(spark):
    df = spark.createDataFrame([(1, page([fragment()]))], "page_id bigint, html string")
    plan = extract_listings(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan


def test_filters_on_lines_run_no_pattern_again(spark):
    """Eight fields, colours and scripts: ten patterns, however many conditions read a line."""
    pages = spark.createDataFrame([(1, "")], "page_id bigint, html string")
    lines = arity_filter(listing_lines(match_colors(with_script(pages))))
    for df in (lines, distinct_lines(lines)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 10


def test_pages_from_rows_exchange_them_once(spark):
    """Pages of about a hundred listings each, in order of the listings; a null page gives none, and no row is lost."""
    rows = spark.range(331).selectExpr(
        "if(id < 330, if(id < 250, 1, id), null) as page_id", "concat(cast(id as string), '-x') as listing_id", "1 as copy", "1.5D as price",
        "'m' as make", "'n' as model", "2000 as year", "'b' as body_style", "'c' as city", "'s' as state", "2.0D as mileage",
        "concat('k', cast(id as string)) as color")
    pages = pages_from(rows)
    assert pages._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert pages.where("page_id = 1").count() == 3 and pages.where("page_id > 1").count() == 80
    found = extract_listings(pages).collect()
    assert sorted(r["color"] for r in found) == sorted(f"k{i}" for i in range(330))
    assert all(r["page_id"] == (1 if int(r["color"][1:]) < 250 else int(r["color"][1:])) for r in found)


def test_fields_between_fixed_texts_need_no_regular_expression(spark):
    """They are what the pattern finds: on each line from the first text before to the last one behind, a value of one character at least."""
    from lotbook.functions import text as X

    a, z = '"make":"', '","makeId"'
    texts = ["", "\n", a + "x" + z, a + z, a + z + a + "b" + z, f"{a}a\n{z}x{a}q{z}\n{a}é漢{z}", z + a, a + a + "x" + z, f"{a}\r{a}w{z} {z}", None, a[:-1] + z, f"{z}{a}ok{z}{a}"]
    rows = spark.createDataFrame([(t,) for t in texts], "f string")
    pattern = X.FIELD_PATTERNS["make"]
    by_pattern = F.array_join(F.regexp_extract_all("f", F.lit("(?d)" + pattern), F.lit(1)), ", ")
    found = rows.select(by_pattern.alias("a"), X.cut_field(F.col("f"), pattern).alias("b")).collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] and {"x", "q, é漢", None} <= {r["b"] for r in found}
    assert "regexp" not in rows.select(*[X.cut_field(F.col("f"), p) for p in X.FIELD_PATTERNS.values()])._jdf.queryExecution().toString()
    assert "regexp" in rows.select(X.cut_field(F.col("f"), X.UNUSED_FIELD_PATTERNS["color"]))._jdf.queryExecution().toString()

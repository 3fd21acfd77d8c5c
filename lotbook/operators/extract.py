"""Stored pages to listing rows.

Everything of one page happens in the row of that page: fragments, fields, colours by position, the
check of each line and the removal of repeated lines. Only then are the listings spread over rows, so
the whole extraction is one narrow stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.functions import text as X
from lotbook.functions.cells import typed_columns
from lotbook.schemas import LISTINGS_RAW, NA_WORDS

PAGE_ID = "page_id"
FIELDS = list(X.FIELD_PATTERNS)
N_COMMAS = len(FIELDS)

# Why a fragment or page gives no row.
NO_SCRIPT = "no script block"
NO_LISTING = "no listing fragment"
NO_COLOR = "no colour at this position"
ALL_MISSING = "all fields missing"
GAP = "missing field between present fields"
COMMAS = "wrong number of commas"


def with_script(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``script``: all script blocks of the page as one text."""
    return pages.withColumn("script", X.script_blocks(F.col(html)))


def split_fragments(pages: DataFrame, text: str = "script") -> DataFrame:
    """page_id, pos, fragment: the text cut at every fragment mark."""
    return pages.select(PAGE_ID, F.posexplode(X.fragments(F.col(text))).alias("pos", "fragment"))


def inventory_fragments(pages: DataFrame, text: str = "script") -> DataFrame:
    """page_id, pos, fragment: the fragments with a listing, numbered among themselves."""
    return pages.select(PAGE_ID, F.posexplode(X.listing_fragments(F.col(text))).alias("pos", "fragment"))


def extract_fields(df: DataFrame, patterns: Mapping[str, str], fragment: str = "fragment") -> DataFrame:
    """One text column per pattern next to the other columns; null where there is no match."""
    keep = [c for c in df.columns if c != fragment]
    found = df.select(*keep, *[X.field(F.col(fragment), p).alias(name) for name, p in patterns.items()])
    return found.select(*keep, *[F.nullif(F.col(name), F.lit("")).alias(name) for name in patterns])


def colors(pages: DataFrame, text: str = "script") -> DataFrame:
    """page_id, pos, color"""
    return pages.select(PAGE_ID, F.posexplode(X.page_colors(F.col(text))).alias("pos", "color"))


def positional_match(df: DataFrame, left: str, right: str, left_name: str, right_name: str) -> DataFrame:
    """One row per pair of entries at the same position of two array columns; the longer one's
    surplus is left out. The other columns are kept."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(
        F.slice(left, F.lit(1), n).alias(left_name), F.slice(right, F.lit(1), n).alias(right_name)
    )
    others = [c for c in df.columns if c not in (left, right)]
    return df.select(*others, F.posexplode(pairs).alias("pos", "_pair")).select(
        *others, "pos", f"_pair.{left_name}", f"_pair.{right_name}"
    )


def match_colors(pages: DataFrame, text: str = "script") -> DataFrame:
    """page_id, pos, fragment, color: listings with the colour at their position."""
    arrays = pages.select(
        PAGE_ID, X.listing_fragments(F.col(text)).alias("_f"), X.page_colors(F.col(text)).alias("_c")
    )
    return positional_match(arrays, "_f", "_c", "fragment", "color")


def listing_lines(matched: DataFrame) -> DataFrame:
    """page_id, pos, line, present: the line of each listing and which of its fields were found, from
    fragment and color."""
    found = matched.select(
        PAGE_ID, "pos", "color", *[X.field(F.col("fragment"), p).alias(name) for name, p in X.FIELD_PATTERNS.items()]
    )
    cells = [F.col(name) for name in FIELDS]
    made = F.struct(X.line(cells, F.col("color")).alias("line"), X.presence(cells).alias("present"))
    # a filter on the line stays behind the generator, so no pattern runs again for each of its conditions
    return found.select(PAGE_ID, "pos", F.inline(F.array(made)))


def arity_filter(lines: DataFrame, column: str = "line", n_commas: int = N_COMMAS) -> DataFrame:
    """Keep lines with the right number of commas, no gap between present cells, and not all empty."""
    present = F.col("present")
    right = X.n_commas(F.col(column)) == n_commas
    return lines.where(right & ~X.gap_inside(present) & ~X.all_missing(present))


def distinct_lines(lines: DataFrame, keys: Sequence[str] = (PAGE_ID, "line")) -> DataFrame:
    """Each line once per page (for lines that are already rows; ``extract_listings`` needs no shuffle)."""
    return lines.select(*keys).distinct()


def lines_to_columns(
    lines: DataFrame, schema: T.StructType = LISTINGS_RAW, column: str = "line",
    na_words: Sequence[str] = NA_WORDS,
) -> DataFrame:
    """Typed columns from comma-separated lines; the other columns are kept."""
    others = [c for c in lines.columns if c != column]
    cells = lines.withColumn("_cells", F.split(F.col(column), ",", -1))
    text = cells.select(
        *others, *[F.get(F.col("_cells"), i).alias(f.name) for i, f in enumerate(schema.fields)]
    )
    return text.select(*others, *typed_columns(text, schema, na_words))


def judged_lines(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos, line, reason: every listing fragment of every page, with the reason why it gives
    no row (null for good lines). Pages without any fragment appear once. Repeated good lines of a
    page are left out."""
    others = [c for c in pages.columns if c not in (html, PAGE_ID)]
    found = with_script(pages, html).select(
        PAGE_ID, *others, (F.col("script") == "").alias("_blank"),
        X.listing_fragments(F.col("script")).alias("_f"), X.page_colors(F.col("script")).alias("_c"),
    )
    # one step after the other, so that nothing is worked out twice: fields, then line, then verdict
    fields = found.withColumn(
        "_f",
        F.transform(
            "_f",
            lambda part, i: F.struct(
                i.alias("pos"), *[X.cut_field(part, p).alias(name) for name, p in X.FIELD_PATTERNS.items()]
            ),
        ),
    )

    def as_line(item: Column) -> Column:
        cells, color = [item[name] for name in FIELDS], F.get(F.col("_c"), item["pos"])
        text = F.when(color.isNotNull(), X.line(cells, color))
        return F.struct(item["pos"].alias("pos"), text.alias("line"), X.presence(cells).alias("present"))

    def judge(item: Column) -> Column:
        reason = (
            F.when(item["line"].isNull(), NO_COLOR)
            .when(X.all_missing(item["present"]), ALL_MISSING)
            .when(X.gap_inside(item["present"]), GAP)
            .when(X.n_commas(item["line"]) != N_COMMAS, COMMAS)
        )
        return F.struct(item["pos"].alias("pos"), item["line"].alias("line"), reason.alias("reason"))

    judged = fields.select(
        PAGE_ID, *others, "_blank", F.transform(F.transform("_f", as_line), judge).alias("_lines")
    )
    good = F.array_distinct(
        F.transform(F.filter("_lines", lambda x: x["reason"].isNull()), lambda x: x["line"])
    )
    unusable = F.transform(
        F.filter("_lines", lambda x: x["reason"].isNotNull()),
        lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), x["reason"].alias("reason")),
    )
    kept = F.transform(
        good,
        lambda x: F.struct(
            F.lit(None).cast("int").alias("pos"), x.alias("line"), F.lit(None).cast("string").alias("reason")
        ),
    )
    barren = F.array(
        F.struct(
            F.lit(None).cast("int").alias("pos"),
            F.lit(None).cast("string").alias("line"),
            F.when(F.col("_blank"), NO_SCRIPT).otherwise(NO_LISTING).alias("reason"),
        )
    )
    rows = F.when(F.size("_lines") == 0, barren).otherwise(F.concat(kept, unusable))
    return judged.select(PAGE_ID, *others, F.inline(rows))


def good_lines(judged: DataFrame) -> DataFrame:
    """Typed listing rows of the judged lines that are good."""
    return lines_to_columns(judged.where(F.col("reason").isNull()).drop("reason", "pos"))


def extract_with_rejects(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Typed listing rows, and what was left out: page_id, pos, line, reason."""
    judged = judged_lines(pages, html)
    return good_lines(judged), judged.where(F.col("reason").isNotNull())


def extract_listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id and the nine listing columns, from whole pages."""
    return extract_with_rejects(pages, html)[0]

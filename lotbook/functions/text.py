"""Column expressions that cut listings out of page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPT = r"(?is)<script\b[^>]*>.*?</script>"

# The text that separates fragments, the start of a listing fragment, and the pattern
# of each field. The text around each value is part of the page format.
FRAGMENT_MARK = '"type"'
LISTING_START = ':"inventory"'
FIELD_PATTERNS = {
    "price": r',"price":(.+),"mileage":',
    "make": r'"make":"(.+)","makeId"',
    "model": r'"model":"(.+)","modelId"',
    "year": r'"year":(.+),"trim"',
    "body_style": r'"bodyStyle":"(.+)","customerId"',
    "city": r'"city":"(.+),"state":',
    "state": r',"state":"(.+)","truncatedDescription',
    "mileage": r',"mileage":(.+),"vin":',
}
UNUSED_FIELD_PATTERNS = {
    "seller_rating": r',"rating":(.+),"reviewCount"',
    "rating": r'"rating":(.+),"review',
    "color": r'","color":"(.+)"\},\{"@context":"',
}
PAGE_COLOR = r'/","color":"(.*?)"\},\{"@context":"http://schema\.org"'

# Only a line feed ends a line.
LINE_FEED_ONLY = "(?d)"


def script_blocks(html: Column) -> Column:
    """All script elements of a page as one text."""
    return F.array_join(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(0)), ", ")


def fragments(text: Column) -> Column:
    """The text cut at every fragment mark."""
    return F.split(text, FRAGMENT_MARK, -1)


def listing_fragments(text: Column) -> Column:
    """Only the fragments that hold a listing."""
    return F.filter(fragments(text), lambda part: part.startswith(LISTING_START))


def page_colors(text: Column) -> Column:
    """Colours in page order; the n-th belongs to the n-th listing."""
    return F.regexp_extract_all(text, F.lit(LINE_FEED_ONLY + PAGE_COLOR), F.lit(1))


def field(fragment: Column, pattern: str) -> Column:
    """All matches of a field, comma-joined (more than one spoils the line); empty if there is none."""
    return F.array_join(F.regexp_extract_all(fragment, F.lit(LINE_FEED_ONLY + pattern), F.lit(1)), ", ")


def cut_field(fragment: Column, pattern: str) -> Column:
    """What ``field`` gives, in a third of its time if the pattern is fixed text around ``(.+)``.

    Then no search by steps is needed: each line has what lies between the first of the text before and the last of the text behind.
    """
    around = pattern.split("(.+)")
    if len(around) != 2 or not all(around) or any(c in text for text in around for c in r"\.^$|?*+()[]{}"):
        return field(fragment, pattern)
    found = F.transform(F.split(fragment, "\n", -1), lambda one: _between(one, *around))
    return F.when(F.contains(fragment, F.lit("\n")), F.array_join(F.filter(found, lambda x: x != ""), ", ")).otherwise(_between(fragment, *around))


def _between(text: Column, before: str, behind: str) -> Column:
    """What lies between the first ``before`` and the last ``behind``; empty if there is nothing."""
    # in bytes, as characters would be counted anew each time
    start, rest = F.octet_length(F.substring_index(text, before, 1)), F.octet_length(F.substring_index(text, behind, -1))
    fixed = len(before.encode()), len(behind.encode())
    found = F.substr(text.cast("binary"), start + fixed[0] + 1, F.octet_length(text) - start - rest - sum(fixed))
    return found.cast("string")


def line(cells: Sequence[Column], color: Column) -> Column:
    """The listing as one comma-separated line, colour last, without quotes, apostrophes and brackets."""
    joined = F.concat_ws(",", *cells, color)
    return F.translate(F.replace(joined, F.lit("[]"), F.lit(",")), "[]'\"", "")


def presence(cells: Sequence[Column]) -> Column:
    """One digit per cell: 1 if present, 0 if missing."""
    return F.concat(*[F.when(c == "", "0").otherwise("1") for c in cells])


def all_missing(present: Column) -> Column:
    return ~F.contains(present, F.lit("1"))


def gap_inside(present: Column) -> Column:
    """True if a missing cell stands between two present ones.

    Missing cells at either end leave their comma behind, those inside do not, so that only lines
    whose present cells form one run keep the right number of commas.
    """
    return F.contains(F.btrim(present, F.lit("0")), F.lit("0"))


def n_commas(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ",", ""))

"""Tables the toolkit works on. Column names are snake_case; types are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"double": T.DoubleType(), "string": T.StringType(), "int": T.IntegerType()}


def _schema(columns: str) -> T.StructType:
    """From "name type, ..." without needing a session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Headerless shard files, in the order of their cells.
LISTINGS_RAW = _schema(
    "price double, make string, model string, year int, body_style string, city string,"
    " state string, mileage double, color string"
)

# After cleaning: year gives way to age, and mileage and age are scaled to [0, 1].
LISTINGS_CLEAN = _schema(
    "price double, make string, model string, body_style string, city string, state string,"
    " mileage double, color string, age double"
)

# The older eleven-column layout.
LISTINGS_V1 = _schema(
    "price double, make string, model string, year int, body_style string, city string, state string,"
    " mileage double, seller_type string, seller_rating double, review_count int"
)

# Position of each LISTINGS_V1 column in the raw twelve-column layout (position 5 is not used).
RAW_POSITIONS = {
    0: "price", 1: "make", 2: "model", 3: "year", 4: "body_style", 6: "city", 7: "state",
    8: "mileage", 9: "seller_type", 10: "seller_rating", 11: "review_count",
}

ZIP_CODES = _schema("zip int")

# Spellings found in headers, and the canonical name of each.
RENAMES = {
    "Price": "price", "Make": "make", "Model": "model", "Year": "year",
    "Body Style": "body_style", "Body_Style": "body_style", "Body_Sytle": "body_style",
    "City": "city", "State": "state", "Milage": "mileage", "Miles": "mileage", "Color": "color",
    "Age": "age", "Seller_Type": "seller_type",
    "Seller_Review_Score": "seller_rating", "Seller_Rating": "seller_rating",
    "Number_of_Reviews": "review_count", "NUmber_of_Ratings": "review_count",
}

# Cell texts that stand for a missing value (the documented pandas defaults).
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def as_text(schema: T.StructType) -> T.StructType:
    """The same columns, all read as text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])

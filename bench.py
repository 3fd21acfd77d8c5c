"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The fixture views are written as tables first (not timed), as the operators would find them.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import views
from lotbook.operators import clean as C
from lotbook.operators import models as M
from lotbook.operators import stats as A
from lotbook.operators.evaluate import evaluate
from lotbook.operators.extract import extract_listings
from lotbook.operators.features import min_max_scale, one_hot
from lotbook.operators.quantiles import exact_median
from lotbook.operators.rows import with_row_id
from lotbook.operators.sampling import sample_n, split
from lotbook.plans.prepare import prepare
from lotbook.session import build_session, staged
from lotbook.sources.files import read_listings
from lotbook.sources.worklist import crawl_worklist

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
KEY = "listing_id"


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    settings = {}
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        settings["spark__checkpoint__dir"] = tempfile.mkdtemp(prefix="lotbook-bench-")
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false", **settings,
    )
    spark.sparkContext.setLogLevel("OFF")

    def spread(df: DataFrame, label: str) -> DataFrame:
        """The given files are single row groups; a table of this size would have many."""
        return staged(df.repartition(int(CPUS)), label)

    listings = spread(views.listings(spark, SF_DIR), "listings")
    dirty = spread(views.listings_dirty(spark, SF_DIR), "dirty")
    signal = spread(views.price_signal(spark, SF_DIR), "signal")
    pages = spread(views.listing_pages(spark, SF_DIR), "pages")
    zips = staged(views.view(spark, SF_DIR, "zips"), "zips")
    csv = f"{spark.conf.get('spark.checkpoint.dir')}/csv"
    dirty.write.csv(csv)
    makes = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]
    quality: dict[str, float] = {}
    fit_times: dict[str, float] = {}

    def fitted(name, fit):
        def timed() -> None:
            train, test = split(signal, 0.2, KEY)
            start = time.perf_counter()
            model = fit(train)
            fit_times[name] = round(time.perf_counter() - start, 3)
            row = evaluate(M.predict(model, test)).first()
            quality[name] = round(row["rmse_ratio"], 4)

        return timed

    queries = {
        "extract_pages": lambda: run(extract_listings(pages)),
        "scan_csv": lambda: run(read_listings(spark, csv)),
        "worklist": lambda: run(crawl_worklist(zips)),
        "drop_repeats": lambda: run(C.drop_repeats(dirty)),
        "stage_counts": lambda: run(C.stage_counts(dirty)),
        "prepare": lambda: run(prepare([dirty])),
        "scale": lambda: run(min_max_scale(listings, ["mileage", "year"])),
        "top_makes": lambda: run(A.value_counts(listings, "make")),
        "describe_by_make": lambda: run(A.describe(listings, ["price", "mileage"], by=["make"])),
        "median": lambda: run(exact_median(listings, "price")),
        "histogram": lambda: run(A.histogram(listings, "price", 500, "make", makes)),
        "t_tests": lambda: run(A.with_p_values(A.ttest_pairs(listings, "price", "make", groups=makes))),
        "sample": lambda: run(sample_n(listings, 100_000, KEY)),
        "split_exact": lambda: [run(part) for part in split(listings, 0.1, KEY, exact=True)],
        "row_id": lambda: run(with_row_id(listings, KEY)),
        "one_hot": lambda: run(one_hot(listings.select("price", "mileage", "make", "color", "state"))),
        "linear": fitted("linear", lambda train: M.fit_linear(train, ignore=[KEY])),
        "boosting": fitted("boosting", lambda train: M.fit_boosting(train, ignore=[KEY], rounds=20, rate=0.2)),
        "forest": fitted("forest", lambda train: M.fit_forest(train, ignore=[KEY], trees=20)),
    }
    # the start of the engine, and of its models, is not a query
    run(listings.groupBy("make").agg(F.count("*")))
    few = signal.limit(2000)
    evaluate(M.predict(M.fit_boosting(few, ignore=[KEY], rounds=2, depth=2), few)).first()
    M.fit_linear(few.select(KEY, "price", "mileage"), ignore=[KEY])
    times = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "rows": listings.count(),
        "of_these_fitting": fit_times, "rmse_ratio": quality, "rmse_ratio_published_on_other_data": 0.435,
    }))


if __name__ == "__main__":
    main()

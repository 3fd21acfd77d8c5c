"""Files, triggers and buckets grow with the tables; the dirty listings are one join."""

import glob

import pytest
from pyspark.sql import functions as F

from checks import views
from checks.queries import sources as Q
from lotbook.schemas import LISTINGS_RAW
from lotbook.sources import store as S


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def three_lots(monkeypatch):
    """As if the small tables had three lots of line items."""
    monkeypatch.setattr(Q, "ROWS_A_LOT", 2_000)


def test_files_of_a_stream_grow_in_number(spark, sf_dir, three_lots, monkeypatch):
    seen = {}
    real = Q.ingest_stream
    monkeypatch.setattr(Q, "ingest_stream", lambda spark, source, *a, **k: seen.update(source=source, **k) or real(spark, source, *a, **k))
    got = Q.stream_ingest(spark, sf_dir)
    assert len(glob.glob(f"{seen['source']}/part-*")) == 12 and seen["files_per_trigger"] == 6
    assert rows_of(got) == rows_of(views.listings_dirty(spark, sf_dir).where("price is not null and color is not null").distinct())


def test_long_lines_and_buckets_grow_in_number(spark, sf_dir, three_lots, monkeypatch):
    seen = {}
    real = Q.ingest_to_store
    monkeypatch.setattr(Q, "ingest_to_store", lambda spark, source, store, *a, **k: seen.update(source=source, store=store, **k) or real(spark, source, store, *a, **k))
    got = Q.restarted_ingest(spark, sf_dir)
    files = glob.glob(f"{seen['source']}/part-*")
    lines = [open(f).read().splitlines() for f in files]
    assert len(files) == 12 and seen["files_per_trigger"] == 6 and seen["store"].buckets == 24
    assert sum(bool(some) and some[0].endswith(",x") for some in lines) == 3
    whole = views.listings_dirty(spark, sf_dir).where("price is not null and color is not null")
    assert got.where("kind = 'row'").count() == whole.distinct().count()
    assert got.where("kind = 'reject'").count() == whole.where("mileage = 7").count()


def test_dirty_listings_join_once(spark, sf_dir, monkeypatch):
    assert plan_of(views.listings_dirty(spark, sf_dir)).count("FileScan parquet [l_") == 1
    rows = [(f"k{i}", 1.5 * i, "m", "x" * (i % 7), 2000, "b", "c", "s", m, "red" if i % 3 else None)
            for i, m in enumerate([None, 0.0, 5.0, 5.5, 13.0, 46.0, 50.0, float("nan"), 3.0, 3.0, 46.0])]
    made = spark.createDataFrame(rows + rows[:4], "listing_id string, price double, make string, model string, year int, body_style string, "
                                                   "city string, state string, mileage double, color string")
    monkeypatch.setattr(views, "listings", lambda spark, sf_dir: made)
    wanted = spark.sql(views.SQL["listings_dirty"], listings=made)
    got = views.listings_dirty(spark, "none")
    assert got.schema == wanted.schema and rows_of(got) == rows_of(wanted) and got.count() == 21


def test_rows_move_without_their_digests(spark, tmp_path):
    store = S.open_store(spark, str(tmp_path / "s"), LISTINGS_RAW, buckets=5)
    listing = [F.col("id").cast("double").alias("price"), *[F.lit(c).alias(c) for c in ("make", "model")], F.lit(2015).alias("year"),
               *[F.lit(c).alias(c) for c in ("body_style", "city", "state")], F.lit(1.0).alias("mileage"), F.lit("red").alias("color")]
    S.add_batch(spark.range(50).select(*listing), store, 1)
    fresh = S.new_rows(spark.range(30, 80).select(*listing), store, 2)
    (exchange,) = [line for line in plan_of(fresh).splitlines() if "Exchange hashpartitioning" in line and ", 5)" in line]
    assert "Exchange hashpartitioning(unhex(" in exchange  # by the digest, which is no column yet
    assert sorted(r["price"] for r in fresh.collect()) == [float(i) for i in range(50, 80)]

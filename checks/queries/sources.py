"""Scans, writes, work list, ingest."""

from __future__ import annotations

import math

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import query
from checks.views import (
    LISTING_COLUMNS,
    listings,
    listings_dirty,
    oracle_views,
    price_signal,
    table,
    view,
    with_page_id,
)
from lotbook.operators.models import fit_linear, load_model, predict, save_model
from lotbook.operators.rows import with_row_id
from lotbook.operators.sampling import split
from lotbook.schemas import LISTINGS_RAW
from lotbook.session import scratch_path, staged
from lotbook.sources.files import (
    append_batch,
    append_listings,
    read_batches,
    read_listings,
    read_pages,
    read_table,
    read_zip_codes,
    write_csv,
    write_csv_with_row_id,
)
from lotbook.sources.store import add_batch, new_rows, open_store, read_store
from lotbook.sources.worklist import crawl_worklist, shard_number
from lotbook.streaming.ingest import ingest_stream, ingest_to_store, stored_rejects

COLUMNS = ", ".join(LISTING_COLUMNS)
ROWS_A_LOT = 3_000_000


def lots(spark, sf_dir) -> int:
    """How many times the files, those of a trigger and the buckets of a small table: one for every three million line items
    (counted in the footers), so that a task that writes a file or sorts a bucket has the same work at any size."""
    return max(1, math.ceil(table(spark, sf_dir, "lineitem").count() / ROWS_A_LOT))


@query("s1_headerless_csv_shards", f"with {oracle_views('listings_dirty')} select {COLUMNS} from listings_dirty")
def headerless_csv(spark, sf_dir):
    """Twenty headerless shard folders, with missing-value words, read in one scan."""
    root = scratch_path(spark, "shards")
    rows = listings_dirty(spark, sf_dir)
    text = rows.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("N/A" if c == "price" else "null")).alias(c) for c in rows.columns],
        (F.pmod(F.xxhash64("make", "model"), F.lit(20)) + 1).alias("shard"),
    )
    text.write.partitionBy("shard").csv(root)
    return read_listings(spark, [f"{root}/shard=*"])


@query("s2_header_csv", f"with {oracle_views('listings')} select {COLUMNS} from listings")
def header_csv(spark, sf_dir):
    """A file whose header uses other spellings than the canonical names."""
    path = scratch_path(spark, "header")
    rows = listings(spark, sf_dir).select(*LISTING_COLUMNS)
    write_csv(rows.withColumnsRenamed({"body_style": "Body Style", "mileage": "Milage", "price": "Price"}), path)
    return read_table(spark, path, LISTINGS_RAW)


@query("s3_zip_column", f"with {oracle_views('zips')} select zip from zips")
def zip_column(spark, sf_dir):
    path = scratch_path(spark, "zips")
    write_csv(view(spark, sf_dir, "zips").select(F.lit("STANDARD").alias("type"), "zip"), path)
    return read_zip_codes(spark, path)


@query(
    "s4_append_by_shard",
    f"""with {oracle_views('listings')}
    select {COLUMNS}, cast(floor((10000 + (cast(split_part(listing_id, '-', 1) as bigint) * 37) % 90000 - 10000) / 4500.0) + 1 as int) as shard
    from listings""",
)
def append_by_shard(spark, sf_dir):
    """Two appends to one table kept by shard."""
    path = scratch_path(spark, "append")
    zips = F.lit(10000) + (F.col("page_id") * 37) % 90000
    rows = with_page_id(listings(spark, sf_dir)).select(*LISTING_COLUMNS, shard_number(zips).alias("shard"))
    for part in (F.col("mileage") <= 25, F.col("mileage") > 25):
        append_listings(rows.where(part), path)
    return spark.read.parquet(path)


@query("s5_write_csv", f"with {oracle_views('listings')} select {COLUMNS} from listings")
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(listings(spark, sf_dir).select(*LISTING_COLUMNS), path)
    return read_table(spark, path, LISTINGS_RAW)


@query(
    "s6_write_csv_with_row_id",
    f"""with {oracle_views('listings')}
    select row_number() over (order by listing_id) - 1 as row_id, listing_id, price, mileage from listings""",
)
def csv_with_row_id(spark, sf_dir):
    path = scratch_path(spark, "numbered")
    write_csv_with_row_id(listings(spark, sf_dir).select("listing_id", "price", "mileage"), path, ["listing_id"])
    return read_table(
        spark, path, T.StructType.fromDDL("row_id bigint, listing_id string, price double, mileage double")
    )


@query(
    "s6_row_id",
    f"""with {oracle_views('listings')}
    select row_number() over (order by price, listing_id) - 1 as row_id, listing_id, price from listings""",
)
def row_id(spark, sf_dir):
    return with_row_id(listings(spark, sf_dir).select("listing_id", "price"), ["price", "listing_id"])


@query("s7_page_scan", "select page_id, url, html from pages")
def page_scan(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet")


WORKLIST = f"""with {oracle_views('zips')}, page_numbers as (select unnest(generate_series(1, 49)) as page_num)
    select cast(floor((zip - 10000) / 4500.0) + 1 as int) as shard, zip, cast(page_num as int) as page_num,
           concat('https://listings.invalid/search?page=', page_num, '&sort=distance-nearest&zc=', zip) as url
    from zips cross join page_numbers where zip >= 10000 and zip < 100000"""


@query("s8_worklist", WORKLIST)
def worklist(spark, sf_dir):
    return crawl_worklist(view(spark, sf_dir, "zips"))


@query(
    "s9_saved_model",
    f"""with {oracle_views('price_signal')}
    select count(*) as n_rows, 0.0 as largest_difference from price_signal
    where md5(concat(listing_id, ':10')) < '33333333333333333333333333333333'""",
)
def saved_model(spark, sf_dir):
    """Predictions of a model before and after it was saved and loaded."""
    train, test = split(price_signal(spark, sf_dir), 0.2, "listing_id")
    model = fit_linear(train, ignore=["listing_id"])
    path = scratch_path(spark, "model")
    save_model(model, path)
    again = load_model(path)
    # both models see the same rows, so no join is needed
    first = predict(model, test).withColumnRenamed("prediction", "first")
    both = predict(again, first)
    return both.agg(
        F.count("*").alias("n_rows"), F.max(F.abs(F.col("first") - F.col("prediction"))).alias("largest_difference")
    )


@query(
    "s10_stream_ingest",
    f"""with {oracle_views('listings_dirty')}
    select distinct {COLUMNS} from listings_dirty where price is not null and color is not null""",
)
def stream_ingest(spark, sf_dir):
    """Four files of each lot, half of them per trigger."""
    source, out, marks = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-marks"))
    n = lots(spark, sf_dir)
    listings_dirty(spark, sf_dir).repartition(4 * n).write.csv(source)
    ingest_stream(spark, source, out, marks, files_per_trigger=2 * n).awaitTermination()
    return spark.read.parquet(out)


@query(
    "s7_page_sizes",
    "select split_part(url, '/', 3) as host, count(*) as n_pages, cast(sum(length(html)) as bigint) as n_chars from pages group by 1",
)
def page_sizes(spark, sf_dir):
    """Pages and text per host."""
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).agg(
        F.count("*").alias("n_pages"), F.sum(F.length("html")).alias("n_chars")
    )


APPENDED = f"""with {oracle_views('listings')}
    select {COLUMNS}, cast(floor((10000 + (cast(split_part(listing_id, '-', 1) as bigint) * 37) % 90000 - 10000) / 4500.0) + 1 as int) as shard
    from listings"""


@query("s4_append_twice", APPENDED)
def append_twice(spark, sf_dir):
    """Two numbered batches by shard, both of them added twice: the table is that of one time."""
    path = scratch_path(spark, "append-twice")
    zips = F.lit(10000) + (F.col("page_id") * 37) % 90000
    rows = with_page_id(listings(spark, sf_dir)).select(*LISTING_COLUMNS, shard_number(zips).alias("shard"))
    parts = {1: rows.where("mileage <= 25"), 2: rows.where("mileage > 25")}
    for batch in (1, 2, 1, 2):
        append_batch(parts[batch], path, batch)
    return read_batches(spark, path)


@query(
    "c5_new_against_stored",
    f"""with {oracle_views('listings_dirty')} select {COLUMNS} from listings_dirty where mileage > 20
        except select {COLUMNS} from listings_dirty where mileage <= 35""",
)
def new_against_stored(spark, sf_dir):
    """What a batch adds to a store that has most of its rows; the batch before is added twice.

    The listings are written once, as three batches are taken from them."""
    rows = staged(listings_dirty(spark, sf_dir).select(*LISTING_COLUMNS), "dirty")
    store = open_store(spark, scratch_path(spark, "store"), LISTINGS_RAW, buckets=8 * lots(spark, sf_dir))
    for _ in range(2):
        add_batch(rows.where("mileage <= 35"), store, 1)
    return new_rows(rows.where("mileage > 20"), store, 2).select(*LISTING_COLUMNS)


@query(
    "s10_stored_after_batches",
    f"""with {oracle_views('listings_dirty')} select distinct {COLUMNS} from listings_dirty""",
)
def stored_after_batches(spark, sf_dir):
    """Three batches that overlap leave each row once."""
    rows = staged(listings_dirty(spark, sf_dir).select(*LISTING_COLUMNS), "dirty")
    store = open_store(spark, scratch_path(spark, "store"), LISTINGS_RAW, buckets=8 * lots(spark, sf_dir))
    for batch, part in enumerate(("mileage <= 20", "mileage between 10 and 40", "mileage > 30")):
        add_batch(rows.where(part), store, batch)
    return read_store(spark, store)


@query(
    "s10_restart",
    f"""with {oracle_views('listings_dirty')}, long as (
        select {COLUMNS} from listings_dirty where price is not null and color is not null and mileage = 7)
    select distinct 'row' as kind, concat_ws(',', make, model, year, body_style, city, state, color) as line, price, mileage
        from listings_dirty where price is not null and color is not null
    union all select 'reject', concat_ws(',', make, model, year, body_style, city, state, color), price, mileage from long""",
)
def restarted_ingest(spark, sf_dir):
    """Files with lines that are too long, two triggers; the first one is stopped between its two writes, and the run starts again."""
    source, marks, path = (scratch_path(spark, n) for n in ("arriving", "marks", "store"))
    rows = listings_dirty(spark, sf_dir).select(*LISTING_COLUMNS)
    long = rows.where("mileage = 7 and price is not null and color is not null").withColumn("more", F.lit("x"))
    n = lots(spark, sf_dir)
    rows.repartition(3 * n).write.csv(source)
    long.repartition(n).write.mode("append").csv(source)  # behind an exchange, so that the joins before it stay parallel
    store = open_store(spark, path, LISTINGS_RAW, buckets=8 * n)
    run = lambda **more: ingest_to_store(spark, source, store, marks, files_per_trigger=2 * n, **more)
    try:
        run(stop_before=0).awaitTermination()
    except StreamingQueryException as stopped:
        if "stopped before batch 0" not in str(stopped):
            raise
    run().awaitTermination()
    line = F.concat_ws(",", *[c for c in LISTING_COLUMNS if c not in ("price", "mileage")])
    kept = read_store(spark, store).select(F.lit("row").alias("kind"), line.alias("line"), "price", "mileage")
    cells = F.split("line", ",")
    rejects = stored_rejects(spark, store).select(
        F.lit("reject").alias("kind"), F.concat_ws(",", F.slice(cells, 2, 6), F.element_at(cells, 9)).alias("line"),
        cells[0].cast("double").alias("price"), cells[7].cast("double").alias("mileage"),
    )
    return kept.unionAll(rejects)

"""The stream gives what the batch gives."""

from pyspark.sql import functions as F

from lotbook.operators.clean import drop_incomplete, drop_repeats
from lotbook.schemas import LISTINGS_RAW
from lotbook.sources import files
from lotbook.streaming.ingest import clean_stream, ingest_stream, write_stream


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stream_equals_batch_and_goes_on(spark, tmp_path, dirty):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    first, second = dirty.where("mileage <= 25"), dirty.where("mileage > 25").unionByName(dirty.where("mileage = 3"))
    first.repartition(3).write.csv(source)
    ingest_stream(spark, source, out, marks, files_per_trigger=1).awaitTermination()
    assert rows_of(spark.read.parquet(out)) == rows_of(drop_repeats(drop_incomplete(first)))
    second.write.mode("append").csv(source)
    ingest_stream(spark, source, out, marks).awaitTermination()
    assert rows_of(spark.read.parquet(out)) == rows_of(drop_repeats(drop_incomplete(dirty)))


def test_surplus_cells_of_streams_and_tables(spark, tmp_path):
    """Lines with more cells than columns are no rows, also if what is too much is empty; short ones are rows."""
    good, short = "1,a,b,2015,c,d,e,5,red", "2,a,b"
    long = ["3,a,b,2015,c,d,e,5,red,more,cells", "4,a,b,2015,c,d,e,5,red,", "5,a,b,2015,c,d,e,5,red,,x", '6,"a,1",b,2015,c,d,e,5,red,y']
    source, out, marks, table = (str(tmp_path / n) for n in ("in", "out", "marks", "table"))
    for folder, lines in ((source, [good, short, *long]), (table, ["price,make,model,year,body_style,city,state,mileage,color", good, short, *long])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text("\n".join(lines) + "\n")
    batch = files.read_listings(spark, source)
    assert rows_of(batch.select("price", "color")) == [(1.0, "red"), (2.0, None)] and batch.count() == 2
    ingest_stream(spark, source, out, marks).awaitTermination()
    assert rows_of(spark.read.parquet(out)) == rows_of(drop_repeats(drop_incomplete(batch)))
    assert sorted(r["line"] for r in spark.read.parquet(f"{out}-rejects").collect()) == long
    assert sorted(r["line"] for r in files.surplus_lines(spark, source).collect()) == long and files.surplus_lines(spark, source).count() == 4
    read = files.read_table(spark, table, LISTINGS_RAW)
    assert rows_of(read.select("price", "color")) == [(1.0, "red"), (2.0, None)] and read.count() == 2
    assert sorted(r["line"] for r in files.surplus_table_lines(spark, table).collect()) == long


def test_repeats_within_the_watermark(spark, tmp_path, sf_dir):
    """Events arrive twice, some of them late; each is kept once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    late = events.where("event_id % 5 = 0")
    source = str(tmp_path / "events")
    events.unionByName(late).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = write_stream(clean_stream(stream, arrival="ts", delay="400 days"), str(tmp_path / "o"), str(tmp_path / "m"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in events.select("event_id").collect())

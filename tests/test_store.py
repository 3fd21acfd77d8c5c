"""Numbered batches, their restart, and predictions on a stream."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.operators import models as M
from lotbook.operators.clean import drop_incomplete, drop_repeats
from lotbook.schemas import LISTINGS_RAW
from lotbook.sources import files
from lotbook.sources import store as S
from lotbook.streaming import ingest
from lotbook.streaming.score import predict_arriving, score_stream


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def raw(dirty):
    return dirty.select(*LISTINGS_RAW.fieldNames())


def test_batches_in_any_repetition(spark, tmp_path, raw):
    store = S.open_store(spark, str(tmp_path / "s"), LISTINGS_RAW, buckets=4)
    assert S.read_store(spark, store).count() == 0
    first, second = raw.where("mileage <= 30"), raw.where("mileage > 20")
    for batch, rows in ((1, first), (2, second), (1, first), (2, second), (3, first)):
        S.add_batch(rows, store, batch)
    assert rows_of(S.read_store(spark, store)) == rows_of(drop_repeats(raw))
    sizes = {r["batch"]: r["n_rows"] for r in S.batches(spark, store).collect()}
    assert sizes[3] == 0 and sizes[2] == second.subtract(first).count() and sum(sizes.values()) == drop_repeats(raw).count()
    with pytest.raises(ValueError, match="after batch 3"):
        S.add_batch(first, store, 0)


def test_store_is_found_again(spark, tmp_path, raw):
    """A later run, without a catalog of the first one, has the digests and the number of buckets."""
    path = str(tmp_path / "s")
    S.add_batch(raw.where("mileage <= 30"), S.open_store(spark, path, LISTINGS_RAW, buckets=3), 1)
    spark.sql(f"drop table {S.open_store(spark, path, LISTINGS_RAW).keys}")  # of an external table, the files stay
    again = S.open_store(spark, path, LISTINGS_RAW, buckets=11)
    assert again.buckets == 3
    assert S.new_rows(raw.where("mileage <= 30"), again, 2).count() == 0
    assert S.new_rows(raw, again, 2).count() == raw.where("mileage > 30").distinct().count()


def test_a_batch_counts_when_it_is_complete(spark, tmp_path, raw, monkeypatch):
    """Stopped after its rows were written, a batch is not read; added again, it is there once."""
    store = S.open_store(spark, str(tmp_path / "s"), LISTINGS_RAW, buckets=4)
    S.add_batch(raw.where("mileage <= 10"), store, 1)
    with monkeypatch.context() as patch:
        patch.setattr(S, "row_digest", S.row_digest)
        real = spark.sql
        patch.setattr(type(spark), "sql", lambda self, text, *a, **k: 1 / 0 if text.startswith("insert") else real(text, *a, **k))
        with pytest.raises(ZeroDivisionError):
            S.add_batch(raw.where("mileage <= 20"), store, 2)
    assert rows_of(S.read_store(spark, store)) == rows_of(drop_repeats(raw.where("mileage <= 10")))
    S.add_batch(raw.where("mileage <= 20"), store, 2)
    assert rows_of(S.read_store(spark, store)) == rows_of(drop_repeats(raw.where("mileage <= 20")))


def test_digests_of_nulls_zeros_and_text(spark):
    schema = T.StructType.fromDDL("a string, b double")
    rows = spark.createDataFrame([("x", 0.0), ("x", -0.0), ("x", None), (None, 0.0), ("null", 0.0), ('x","b":0', 0.0), (None, None)], schema)
    assert rows.select(S.row_digest(schema)).distinct().count() == 6


def test_append_by_batch_and_shard(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(10).select("id", (F.col("id") % 3).cast("int").alias("shard"))
    for batch in (1, 2, 1):
        files.append_batch(rows.withColumn("id", F.col("id") + 100 * batch), path, batch)
    assert sorted(r["id"] for r in files.read_batches(spark, path).collect()) == [*range(100, 110), *range(200, 210)]
    files.append_batch(rows.limit(1), path, 2)  # fewer shards than before
    assert files.read_batches(spark, path).count() == 11


@pytest.mark.parametrize("stopped", [None, 0, 1])
def test_ingest_is_exactly_once(spark, tmp_path, raw, stopped):
    """A run stopped between its two writes, and started again, gives the tables of an undisturbed one."""
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    raw.repartition(3).write.csv(source)
    long = ["3,a,b,2015,c,d,e,5,red,more,cells", "4,a,b,2015,c,d,e,5,red,"]
    (tmp_path / "in" / "z.csv").write_text("\n".join(long) + "\n")
    store = S.open_store(spark, str(tmp_path / "s"), LISTINGS_RAW, buckets=4)
    if stopped is not None:
        with pytest.raises(StreamingQueryException, match="stopped before"):
            ingest.ingest_to_store(spark, source, store, marks, files_per_trigger=2, stop_before=stopped).awaitTermination()
    ingest.ingest_to_store(spark, source, store, marks, files_per_trigger=2).awaitTermination()
    (tmp_path / "in" / "late.csv").write_text("7,a,b,2015,c,d,e,5,red\n")  # known and new rows, later
    raw.where("mileage = 3").write.mode("append").csv(source)
    ingest.ingest_to_store(spark, source, store, marks).awaitTermination()
    late = spark.createDataFrame([(7.0, "a", "b", 2015, "c", "d", "e", 5.0, "red")], LISTINGS_RAW)
    assert rows_of(S.read_store(spark, store)) == rows_of(drop_repeats(drop_incomplete(raw)).unionAll(late))
    assert sorted(r["line"] for r in ingest.stored_rejects(spark, store).collect()) == long


def test_rows_are_predicted_as_they_come(spark, tmp_path, signal):
    """Four triggers, then two more files with the same checkpoint; missing numbers give no prediction and stop nothing."""
    columns = ["listing_id", "make", "state", "mileage"]
    rows = signal.select("price", *columns)
    model, source, out, marks = (str(tmp_path / n) for n in ("model", "in", "out", "marks"))
    fitted = M.fit_linear(rows, ignore=["listing_id"])
    M.save_model(fitted, model)
    schema = T.StructType([f for f in rows.schema.fields if f.name in columns])
    rows.select(*schema.fieldNames()).repartition(4).write.csv(source)
    query = score_stream(spark, model, source, out, marks, schema, ["listing_id"], files_per_trigger=1)
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4
    wanted = rows_of(M.predict(fitted, rows, ["listing_id"]))
    assert rows_of(spark.read.parquet(out)) == wanted
    names = schema.fieldNames()
    odd = {"odd1": {"mileage": ""}, "odd2": {"make": "never seen", "mileage": "3"}, "odd3": {"make": "", "state": "", "mileage": "nan"}}
    for key, cells in odd.items():
        (tmp_path / "in" / f"{key}.csv").write_text(",".join({"listing_id": key, "make": "Brand#1", "state": "ASIA", **cells}[n] for n in names) + "\n")
    score_stream(spark, model, source, out, marks, schema, ["listing_id"]).awaitTermination()
    found = {r["listing_id"]: r["prediction"] for r in spark.read.parquet(out).collect()}
    assert len(found) == len(wanted) + 3
    assert found["odd1"] is None and found["odd3"] is None and found["odd2"] is not None
    assert rows_of(predict_arriving(fitted, rows, ["listing_id"])) == wanted


def test_a_trigger_is_kept_in_memory_only(spark, sf_dir, monkeypatch):
    """What does not fit is read again; on disk it would be larger than its files."""
    from checks.queries import sources as Q
    from pyspark import StorageLevel

    levels, kind = [], type(spark.range(1))
    real = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, level=StorageLevel.MEMORY_AND_DISK_DESER: levels.append(level) or real(self, level))
    Q.restarted_ingest(spark, sf_dir)
    assert len(levels) == 3 and all(level.useMemory and not level.useDisk for level in levels)

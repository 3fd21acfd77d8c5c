"""Scans, writes, the work list."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotbook.functions.cells import typed
from lotbook.operators.combine import union_outer, union_same
from lotbook.plans.harvest import harvest, harvest_to
from lotbook.schemas import LISTINGS_RAW, LISTINGS_V1
from lotbook.session import shared_dir
from lotbook.sources import files
from lotbook.sources.worklist import crawl_worklist
from tests.test_extract import fragment, page


def test_missing_words_and_odd_numbers(spark, tmp_path):
    (tmp_path / "list1.csv").write_text(
        "9500,Ford,Focus,2015.0,Hatchback,Albany,NY,51000,Red\n"
        "null,NA,Focus,2015,Hatchback,Albany,N/A,nan,\n"
        "5d,Ford,Focus,20x5,Hatchback,Albany,NY, 12 ,Red\n"
        "1e4,Ford,Focus\n"
    )
    (tmp_path / "list2.csv").write_text("1,A,B,2001,C,D,E,2,F\n")
    rows = files.read_listings(spark, [str(tmp_path / "list1.csv"), str(tmp_path / "list2.csv")], file_column="file")
    got = {tuple(r) for r in rows.collect()}
    assert got == {
        (9500.0, "Ford", "Focus", 2015, "Hatchback", "Albany", "NY", 51000.0, "Red", "list1.csv"),
        (None, None, "Focus", 2015, "Hatchback", "Albany", None, None, None, "list1.csv"),
        (None, "Ford", "Focus", None, "Hatchback", "Albany", "NY", 12.0, "Red", "list1.csv"),
        (10000.0, "Ford", "Focus", None, None, None, None, None, None, "list1.csv"),
        (1.0, "A", "B", 2001, "C", "D", "E", 2.0, "F", "list2.csv"),
    }


def test_header_spellings_and_extra_columns(spark, tmp_path):
    (tmp_path / "old.csv").write_text(
        "Price,Make,Model,Year,Body_Sytle,City,State,Milage,Seller_Type,Seller_Review_Score,Number_of_Reviews,Extra\n"
        "1,A,B,2001,C,D,E,2,Dealer,4.5,10,zzz\n"
    )
    rows = files.read_table(spark, str(tmp_path / "old.csv"), LISTINGS_V1)
    assert [tuple(r) for r in rows.collect()] == [(1.0, "A", "B", 2001, "C", "D", "E", 2.0, "Dealer", 4.5, 10)]
    assert files.read_table(spark, str(tmp_path / "old.csv"), LISTINGS_RAW).first()["color"] is None


def test_zip_column_only(spark, tmp_path):
    (tmp_path / "zips.csv").write_text("type,zip,city\nSTANDARD,00501,Holtsville\nPO BOX,10001,New York\n")
    df = files.read_zip_codes(spark, str(tmp_path / "zips.csv"))
    assert sorted(r["zip"] for r in df.collect()) == [501, 10001]
    assert "city" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_worklist_edges(spark):
    zips = [*range(9990, 10011), 14499, 14500, 54999, 55000, 99999, 100000]
    work = crawl_worklist(spark.createDataFrame([(z,) for z in zips], "zip int"))
    shards = {(r["zip"], r["shard"]) for r in work.select("zip", "shard").distinct().collect()}
    assert {s for z, s in shards if z == 55000} == {11}
    assert {s for z, s in shards if z == 54999} == {10}
    assert dict(shards)[14499] == 1 and dict(shards)[14500] == 2 and dict(shards)[99999] == 20
    assert min(z for z, _ in shards) == 10000 and max(z for z, _ in shards) == 99999
    pages = work.where("zip = 10000").agg(F.min("page_num"), F.max("page_num"), F.count("*")).first()
    assert tuple(pages) == (1, 49, 49)
    assert "page=1&" in work.where("zip = 10000 and page_num = 1").first()["url"]


def test_append_keeps_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    for k in range(2):
        files.append_listings(spark.range(100).select("id", (F.col("id") % 3).alias("shard")), path)
    assert spark.read.parquet(path).count() == 200
    plan = spark.read.parquet(path).where("shard = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan


def test_csv_with_row_id(spark, tmp_path):
    path = str(tmp_path / "numbered")
    files.write_csv_with_row_id(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), path, ["k"])
    rows = spark.read.option("header", True).csv(path).collect()
    assert sorted((r["row_id"], r["k"]) for r in rows) == [("0", "a"), ("1", "b"), ("2", "c")]


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "n int, color string")
    b = spark.createDataFrame([(2,)], "n int")
    assert sorted(map(tuple, union_outer([b, a], sort_columns=True).collect()), key=str) == [("x", 1), (None, 2)]
    assert union_same([a, a, a]).count() == 3


def test_harvest_to_shards(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, 10001, page([fragment(), fragment(city="Troy")])), (2, 99999, page([fragment()])), (3, 501, page([fragment()]))],
        "page_id bigint, zip int, html string",
    )
    path = str(tmp_path / "harvest")
    harvest_to(pages, path)
    rows = spark.read.parquet(path)
    assert sorted((r["page_id"], r["shard"]) for r in rows.collect()) == [(1, 1), (1, 1), (2, 20)]
    assert harvest(pages)[1].count() == 0


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir() is not None


@pytest.mark.parametrize("name", ["price", "year"])
def test_schema_types(name):
    assert LISTINGS_RAW[name].dataType.simpleString() == {"price": "double", "year": "int"}[name]


def test_headers_of_different_layouts(spark, tmp_path):
    for name, text in (("a", "Price,Make,City\n1.5,Audi,Oslo\n"), ("b", "City,Make,Price\nRome,Fiat,2.0\n"), ("c", "color,price\nred,3\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    renames = {"Price": "price", "Make": "make", "City": "city"}
    rows = files.read_table(spark, str(tmp_path), LISTINGS_RAW, renames).select("price", "make", "city", "color").collect()
    assert sorted(map(tuple, rows)) == [(1.5, "Audi", "Oslo", None), (2.0, "Fiat", "Rome", None), (3.0, None, None, "red")]
    (tmp_path / "d.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        files.read_table(spark, str(tmp_path), LISTINGS_RAW, renames)


def test_surplus_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,a,b,2015,c,d,e,5,red\n2,a,b,2015,c,d,e,5,red,more,cells\n")
    assert [r["price"] for r in files.read_listings(spark, str(tmp_path)).collect()] == [1.0]
    (left,) = files.surplus_lines(spark, str(tmp_path)).collect()
    assert left["cells"][0] == "2" and left["cells"][-1] == "more"


def test_big_whole_numbers(spark):
    cells = ["9007199254740993", "-5", " 7 ", "2015.0", "2015.7", "2e3", "1e-1", "", "x", "99999999999999999999"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r["v"] for r in df.select("i", typed(F.col("c"), T.LongType()).alias("v")).orderBy("i").collect()]
    assert got == [9007199254740993, -5, 7, 2015, None, 2000, None, None, None, None]

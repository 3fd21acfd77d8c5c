"""What some physical plans must look like (test_oracle looks at the plan of every query)."""

from pyspark.sql import functions as F

from lotbook.operators import stats as A
from lotbook.operators.clean import drop_incomplete, drop_repeats


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_no_full_sort(listings):
    assert "TakeOrderedAndProject" in plan_of(A.value_counts(listings, "make"))


def test_scans_read_only_the_columns_they_need(listings):
    plan = listings.where(F.col("make") == "Brand#1").groupBy("city").count()._jdf.queryExecution().toString()
    assert "ReadSchema: struct<make:string,city:string>" in plan
    assert "EqualTo(make,Brand#1)" in plan


def test_copies_meet_before_the_shuffle(dirty):
    plan = plan_of(drop_repeats(drop_incomplete(dirty)))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert "IsNotNull(price), IsNotNull(make)" in drop_incomplete(dirty)._jdf.queryExecution().executedPlan().toString()

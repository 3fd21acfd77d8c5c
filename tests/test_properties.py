"""Properties that hold for any data, and brute-force comparisons on small tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotbook.functions.distributions import two_sided_p
from lotbook.functions.hashing import share_limit
from lotbook.operators import clean as C
from lotbook.operators import features as X
from lotbook.operators import quantiles as Q
from lotbook.operators import sampling as G
from lotbook.operators import stats as A
from lotbook.operators.rows import with_row_id


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedupe_twice_is_dedupe_once(dirty):
    once = C.drop_repeats(dirty)
    assert as_set(once) == as_set(C.drop_repeats(once))


def test_null_drop_and_dedupe_commute(dirty):
    assert as_set(C.drop_incomplete(C.drop_repeats(dirty))) == as_set(C.drop_repeats(C.drop_incomplete(dirty)))


def test_nan_free_null_counts_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2.0, 1)], "a double, b int")
    assert C.drop_repeats(df).count() == 2


def test_stage_counts(spark, dirty):
    n = {r["stage"]: r["n_rows"] for r in C.stage_counts(dirty).collect()}
    assert n["all_rows"] == dirty.count() > n["no_repeats"] > n["complete"] > 0
    empty = {r["stage"]: r["n_rows"] for r in C.stage_counts(dirty.limit(0)).collect()}
    assert set(empty.values()) == {0}


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 4.0, 10.0],
    [5.0],
    [0.0] * 500 + [float(i) for i in range(500)],
    [7.0] * 900 + [float(i) for i in range(100)],
    [float(i % 3) for i in range(1000)],
    [random.Random(1).lognormvariate(0, 3) for _ in range(3000)],
])
@pytest.mark.parametrize("accuracy, ordered", [(10_000, 100_000), (20, 100_000), (20, 10)])
def test_quantiles_are_exact(spark, monkeypatch, values, accuracy, ordered):
    """Also with a coarse sketch, with one value holding most of the rows, and with brackets that are cut again."""
    monkeypatch.setattr(Q, "ORDERED", ordered)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = {r["prob"]: r["quantile"] for r in Q.exact_quantiles(df, "x", probs, accuracy=accuracy).collect()}
    for p in probs:
        assert found[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("ordered", [100_000, 3])
def test_quantiles_by_group(spark, monkeypatch, ordered):
    """One group holds most rows; with brackets ordered at once, and cut until three values are left."""
    monkeypatch.setattr(Q, "ORDERED", ordered)
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}", rng.randrange(50) * 0.5) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double")
    found = {(r["g"], r["prob"]): r["quantile"] for r in Q.exact_quantiles(df, "x", [0.25, 0.5], ["g"], 50).collect()}
    groups = {g for g, _ in rows}
    assert len(found) == 2 * len(groups)
    for g in groups:
        for p in (0.25, 0.5):
            assert found[g, p] == pytest.approx(np.quantile([x for h, x in rows if h == g], p))


def test_only_the_frequent_value_is_ordered(spark):
    """A value with most of the rows keeps the smaller ones out of the range that is sorted."""
    df = spark.range(10_000).select(F.when(F.col("id") < 3000, F.col("id")).otherwise(5000).cast("double").alias("x"))
    table = Q.exact_quantiles(df, "x", [0.5])
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "5000.0" in plan
    assert table.first()["quantile"] == 5000.0


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_ordered_values_do_not_grow(spark, monkeypatch, n):
    """However many rows lie within a bracket, a task orders a fixed number of values."""
    monkeypatch.setattr(Q, "ORDERED", 50)
    seen, narrowed = [], Q._narrowed

    def watched(copies, by):
        seen.append(narrowed(copies, by))
        return seen[-1]

    monkeypatch.setattr(Q, "_narrowed", watched)
    df = spark.range(n).select((F.col("id") * 0.5).alias("x"))
    found = {r["prob"]: r["quantile"] for r in Q.exact_quantiles(df, "x", [0.3, 0.5], accuracy=20).collect()}
    assert found == {p: pytest.approx((n - 1) * p * 0.5) for p in (0.3, 0.5)}
    assert seen[0].groupBy("_b").count().agg(F.max("count")).first()[0] <= 50


def test_quantiles_of_nothing(spark):
    assert Q.exact_quantiles(spark.range(0).withColumn("x", F.col("id")), "x", [0.5]).collect() == []


def test_describe_matches_by_hand(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    row = A.describe(df, ["x"]).first()
    assert (row["count"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == (4, 1, 1.75, 3, 5.5, 10)
    assert row["std"] == pytest.approx(np.std([1, 2, 4, 10], ddof=1))
    rough = A.describe(df, ["x"], approx=True).first()
    assert rough["p25"] in (1.0, 2.0) and rough.__fields__ == row.__fields__


def test_histogram_counts_every_row(listings):
    makes = ["Brand#1", "Brand#2"]
    rows = A.histogram(listings, "price", 500, "make", makes).collect()
    assert len(rows) == 1000
    assert sum(r["n_rows"] for r in rows) == listings.where(F.col("make").isin(makes)).count()
    assert any(r["n_rows"] == 0 for r in rows)


def test_histogram_matches_numpy(spark):
    values = [random.Random(3).gauss(0, 1) for _ in range(2000)] + [3.9, 3.9]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    counts = [r["n_rows"] for r in A.histogram(df, "v", 16, "g").orderBy("bin").collect()]
    assert counts == list(np.histogram(values, 16)[0])


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("a", 3.0)] * 5, "g string, v double")
    rows = A.histogram(df, "v", 4, "g").orderBy("bin").collect()
    assert [r["n_rows"] for r in rows] == list(np.histogram([3.0] * 5, 4)[0])
    assert (rows[0]["lo"], rows[-1]["hi"]) == (2.5, 3.5)


def test_density_has_area_one(listings):
    rows = A.density_histogram(listings, "price", 60).collect()
    assert sum(r["density"] * (r["hi"] - r["lo"]) for r in rows) == pytest.approx(1.0)


def test_normal_draws_look_normal(listings):
    draws = np.array([r["draw"] for r in A.normal_draws(listings, "price", "listing_id").collect()])
    prices = np.array([r["price"] for r in listings.select("price").collect()])
    assert abs(draws.mean() - prices.mean()) < 4 * prices.std() / math.sqrt(len(prices))
    assert draws.std() == pytest.approx(prices.std(), rel=0.05)


def test_t_test_by_hand(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 9.0], [2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 20.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    row = A.ttest_ind(df, "v", "g", "a", "b").first()
    pooled = (4 * np.var(a, ddof=1) + 6 * np.var(b, ddof=1)) / 10
    assert row["t"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / 5 + 1 / 7)))
    assert row["dof"] == 10 and 0 < row["p"] < 1


@pytest.mark.parametrize("t, dof, p", [
    (2.228138852, 10, 0.05), (0.0, 5, 1.0), (12.70620474, 1, 0.05), (1.0, 1, 0.5), (1.959963985, 1e9, 0.05),
    (1.98397152, 100, 0.05), (3.390491311, 100, 0.001),
])
def test_p_value(t, dof, p):
    assert two_sided_p(t, dof) == pytest.approx(p, rel=1e-6)
    assert two_sided_p(-t, dof) == two_sided_p(t, dof)


def test_p_value_is_continuous_where_the_method_changes():
    assert two_sided_p(2.0, 100_000) == pytest.approx(two_sided_p(2.0, 100_001), rel=1e-6)


def test_split_parts_are_disjoint_complete_and_stable(listings):
    train, test = G.split(listings, 0.2, "listing_id")
    ids = {r[0] for r in test.select("listing_id").collect()}
    others = {r[0] for r in train.select("listing_id").collect()}
    assert not ids & others and len(ids) + len(others) == listings.count()
    assert abs(len(ids) / listings.count() - 0.2) < 0.03
    again = G.split(listings.repartition(13), 0.2, "listing_id")[1]
    assert ids == {r[0] for r in again.select("listing_id").collect()}


@pytest.mark.parametrize("share", [0.1, 0.2, 0.0, 1.0])
def test_exact_split_size(listings, share):
    train, test = G.split(listings, share, "listing_id", exact=True)
    assert test.count() == math.ceil(listings.count() * share)
    assert train.count() == listings.count() - test.count()


def test_share_limit():
    assert share_limit(0.2) == "3" * 32
    assert share_limit(0.5) == "8" + "0" * 31
    assert share_limit(1) > "f" * 32


@pytest.mark.parametrize("margin", [8, 0.01])
@pytest.mark.parametrize("n", [1, 17, 999, 1000, 1001])
def test_sample_n(spark, monkeypatch, margin, n):
    """Also with a margin so small that it has to be widened."""
    monkeypatch.setattr(G, "MARGIN", margin)
    df = spark.range(1000).withColumn("key", F.col("id").cast("string"))
    digests = sorted((hashlib.md5(f"{i}:10".encode()).hexdigest(), i) for i in range(1000))
    got = sorted(r["id"] for r in G.sample_n(df, n, "key").collect())
    assert got == sorted(i for _, i in digests[:n])


def test_sample_is_no_limit(listings):
    plan = G.sample_n(listings, 500, "listing_id")._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "Exchange" not in plan and "TakeOrdered" not in plan


def test_folds_cover_all_rows(listings):
    counts = {r["fold"]: r["count"] for r in G.with_fold(listings, 5, "listing_id").groupBy("fold").count().collect()}
    assert set(counts) == set(range(5)) and sum(counts.values()) == listings.count()


@pytest.mark.parametrize("n, size", [(0, 0), (1, 1), (30, 30), (40, 40), (41, 40)])
def test_first_n_is_a_filter(spark, n, size):
    df = spark.range(40).select((F.col("id") * 7 % 40).alias("k"), F.lit("x").alias("v"))
    result = G.first_n(df, n, "k")
    assert sorted(r["k"] for r in result.collect()) == list(range(size))
    assert "Limit" not in result._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [200_000, 3000])
def test_first_n(spark, monkeypatch, rows):
    monkeypatch.setattr(G, "SAMPLE_ROWS", rows)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("a"), "id").repartition(7)
    expected = sorted((i * 7919 % 20_011, i) for i in range(20_000))[:5000]
    assert sorted(map(tuple, G.first_n(df, 5000, ["a", "id"]).collect())) == expected


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    rows = with_row_id(df, "k").orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(5000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)
    assert with_row_id(df.limit(0), "k").collect() == []


def test_scaled_values(listings):
    scaled = X.min_max_scale(listings.withColumn("fixed", F.lit(4)), ["mileage", "year", "fixed"])
    row = scaled.agg(*[f(c).alias(f"{n}_{c}") for c in ("mileage", "year", "fixed") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    assert (row["lo_mileage"], row["hi_mileage"], row["lo_year"], row["hi_year"]) == (0, 1, 0, 1)
    assert (row["lo_fixed"], row["hi_fixed"]) == (0, 0)
    assert scaled.columns == [*listings.columns, "fixed"]


def test_scaling_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert sorted((r["x"] for r in X.min_max_scale(df, ["x"]).collect()), key=str) == [0.0, 1.0, None]


def test_one_hot_marks_exactly_one_column(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "c string, x int")
    wide = X.one_hot(df)
    assert wide.columns == ["x", "c_a", "c_b", "c_nan"]
    assert as_set(wide) == [(1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1)]
    with pytest.raises(ValueError):
        X.one_hot(df, max_columns=1)


def test_tighten_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "true", "5d", 2.0, 2.5, None), (None, "2", "FALSE", "7", 3.0, 1.0, None)],
        "a string, b string, c string, d string, e double, f double, g string",
    )
    types = dict(C.tighten_types(df).dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "bigint", "f": "double", "g": "string"}


def test_strict_cast_stops_on_bad_text(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        C.whole_number(spark.createDataFrame([("x",)], "year string"), "year").collect()


def test_positional_projection(spark):
    df = spark.createDataFrame([tuple(range(12))], ", ".join(f"c{i} int" for i in range(12)))
    row = C.project_positional(df).first()
    assert tuple(row) == (0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11)


def test_row_counts_has_the_total(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "m string")
    assert as_set(A.row_counts(df, "m", ["a"])) == as_set(spark.createDataFrame([("a", 2), (None, 4)], "m string, n bigint"))

"""Closed forms, quality against the baseline, repeatability."""

import math

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from lotbook.operators import features as X
from lotbook.operators import models as M
from lotbook.operators.evaluate import evaluate, leaderboard
from lotbook.operators.features import feature_names, price_bands
from lotbook.operators.sampling import split
from lotbook.plans.describe import overview
from lotbook.plans.prepare import prepare
from lotbook.plans.train import compare_models

KEY = "listing_id"


@pytest.fixture(scope="module")
def parts(signal):
    return split(signal, 0.2, KEY)


@pytest.fixture(scope="module")
def linear(parts):
    return M.fit_linear(parts[0], ignore=[KEY])


def small(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [2.0, -1.0, 4.0] + rng.normal(size=200) + 7
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, price double")
    unit = (x - x.mean(0)) / np.sqrt(((x - x.mean(0)) ** 2).sum(0))
    return df, x, y, unit


def test_ridge_closed_form(spark):
    df, x, y, unit = small(spark)
    w = np.linalg.solve(unit.T @ unit + np.eye(3), unit.T @ (y - y.mean()))
    expected = y.mean() + unit @ w
    got = [r["prediction"] for r in M.predict(M.fit_ridge(df, 1.0), df).collect()]
    assert np.allclose(sorted(got), sorted(expected), atol=1e-8)


def test_lasso_coordinate_descent(spark):
    df, x, y, unit = small(spark)
    alpha, n, w = 0.05, len(y), np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            rest = y - y.mean() - unit @ w + unit[:, j] * w[j]
            rho = unit[:, j] @ rest
            w[j] = np.sign(rho) * max(abs(rho) - n * alpha, 0)
    got = [r["prediction"] for r in M.predict(M.fit_lasso(df, alpha), df).collect()]
    assert np.allclose(sorted(got), sorted(y.mean() + unit @ w), atol=1e-6)


def test_linear_beats_the_baseline(parts, linear):
    row = evaluate(M.predict(linear, parts[1])).first()
    assert row["rmse_ratio"] < 0.3 and row["r2"] > 0.9


def test_label_and_key_are_no_features(parts, linear):
    names = feature_names(linear.transform(parts[0].limit(1)))
    assert not [n for n in names if n.startswith(("price", KEY))]
    assert "make_Brand#1" in names and "make_nan" in names and "year" in names


def test_free_text_is_refused(signal, monkeypatch):
    monkeypatch.setattr(X, "MAX_VALUES", 30)
    with pytest.raises(ValueError, match="listing_id"):
        X.feature_stages(signal, "price")
    assert X.feature_stages(signal, "price", [KEY])


def test_unseen_values_are_accepted(parts, linear):
    odd = parts[1].limit(5).withColumn("make", F.lit("Brand#new")).withColumn("color", F.lit(None).cast("string"))
    assert M.predict(linear, odd).where(F.col("prediction").isNull()).count() == 0


def test_saved_model(tmp_path, parts, linear):
    M.save_model(linear, str(tmp_path / "m"))
    again = M.load_model(str(tmp_path / "m"))
    first = {r[KEY]: r["prediction"] for r in M.predict(linear, parts[1]).collect()}
    assert first == {r[KEY]: r["prediction"] for r in M.predict(again, parts[1]).collect()}


def test_boosting_quality_importances_and_repeat(parts):
    train, test = parts
    model = M.fit_boosting(train, ignore=[KEY], rounds=8, rate=0.4)
    row = evaluate(M.predict(model, test)).first()
    assert row["rmse_ratio"] < 0.435  # the published ratio
    table = M.importances(model, train).collect()
    assert table[0]["feature"] == "make" and sum(r["weight"] for r in table) == pytest.approx(1.0)
    again = M.fit_boosting(train, ignore=[KEY], rounds=8, rate=0.4)
    assert evaluate(M.predict(again, test)).first()["mse"] == row["mse"]


def test_forest_importances_by_column(parts):
    train, _ = parts
    model = M.fit_forest(train, ignore=[KEY], trees=2, depth=5, encoding="one_hot")
    slots = M.importances(model, train)
    columns = M.importances(model, train, per_column=True).collect()
    assert {r["feature"] for r in columns} == {"make", "body_style", "state", "color", "year", "mileage"}
    assert sum(r["weight"] for r in columns) == pytest.approx(1.0)
    assert slots.count() > len(columns)


def test_tree_input_is_dealt_to_more_tasks_as_it_grows(parts, monkeypatch):
    """No task keeps more rows than two files have; the same model where the candidate splits do not depend on the tasks."""
    most, rows, models = [], parts[0].select("price", "make", "mileage").limit(3000), []
    real = M.staged

    def watched(df, label, *more):
        found = real(df.coalesce(1), label, *more)
        most.append(found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(M, "staged", watched)
    for bound in (500_000, 100):
        monkeypatch.setattr(M, "TREE_ROWS", bound)
        models.append(M.fit_boosting(rows, rounds=2, depth=3))
    assert most[0] == 3000 and most[1] <= 200
    one, two = ([r["prediction"] for r in M.predict(m, rows).orderBy("price", "make", "mileage").collect()] for m in models)
    assert one == pytest.approx(two)
    assert M.fold_scores(parts[0], KEY, grid={"numTrees": [1]}, folds=2, depth=2).count() == 2
    assert most[2] <= 200


def test_grid_search(parts):
    table, best, winner = M.grid_search(parts[0], KEY, grid={"numTrees": [1, 3]}, folds=2, depth=3)
    rows = table.collect()
    assert [r["numTrees"] for r in rows] == ["1", "3"]
    assert best["numTrees"] == int(max(rows, key=lambda r: r["mean"])["numTrees"])


def test_bands_tree_and_net(parts):
    train, test = parts
    banded, edges = price_bands(train, 3)
    counts = [r["count"] for r in banded.groupBy("band").count().collect()]
    assert len(edges) == 2 and max(counts) - min(counts) <= 3
    held, _ = price_bands(test, edges=edges)
    tree = M.predict(M.fit_band_tree(banded, ignore=[KEY, "price"], depth=6), held)
    net = M.predict(M.fit_band_net(banded, 3, ignore=[KEY, "price"], hidden=(12,), rounds=40), held)
    for scored in (tree, net):
        assert scored.select(F.avg((F.col("band") == F.col("prediction")).cast("double"))).first()[0] > 0.7


def test_net_agrees_with_sparks_trainer_on_dense_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i % 7}", "all", float(rng.integers(0, 50)), int(rng.integers(1990, 2000))) for i in range(600)]
    rows = [(*r, float((int(r[0][1:]) * 5 + r[2] + rng.uniform()) // 30)) for r in rows]
    train = spark.createDataFrame(rows, "make string, state string, mileage double, year int, band double").repartition(3)
    model = M.fit_band_net(train, 3, ignore=[], hidden=(6, 4), rounds=12)
    dense = PipelineModel(model.stages[:-1]).transform(train)
    width = len(model.stages[-2].originalMax)
    plain = MultilayerPerceptronClassifier(labelCol="band", layers=[width, 6, 4, 3], maxIter=12, blockSize=100, seed=M.SEED).fit(dense)
    # the same objective, start and search, so the same weights but for the order of sums
    assert model.stages[-1].weights.toArray() == pytest.approx(plain.weights.toArray(), rel=1e-5, abs=1e-7)
    start = MultilayerPerceptronClassifier(labelCol="band", layers=[width, 6, 4, 3], maxIter=0, seed=M.SEED).fit(dense)
    assert np.abs(plain.weights.toArray() - start.weights.toArray()).max() > 0.5


def test_net_of_numbers_and_of_text_alone(spark):
    rows = [(f"k{i % 3}", float(i % 3), float(i % 3)) for i in range(90)]
    train = spark.createDataFrame(rows, "make string, mileage double, band double")
    for column in ("make", "mileage"):
        scored = M.predict(M.fit_band_net(train.select(column, "band"), 3, ignore=[], hidden=(5,), rounds=60), train)
        assert scored.where("band <> prediction").isEmpty()


def test_net_keeps_no_dense_rows(spark):
    """A row of a few columns takes a few bytes, however many slots it has."""
    from lotbook.operators import network

    rows = spark.range(4000, numPartitions=2).selectExpr("cast(id as double) as slot", "cast(id % 50 as double) as x", "cast(id % 2 as double) as band")
    stored = network.blocks(rows, ["slot"], ["x"], "band", 2, 100).collect()
    assert sum(r["n"] for r in stored) == 4000
    assert sum(len(r["slots"]) + len(r["numbers"]) + len(r["label"]) for r in stored) == 4000 * 16
    with pytest.raises(PythonException, match="whole numbers from 0 to 0"):
        network.blocks(rows, ["slot"], ["x"], "band", 1, 100).collect()


def test_evaluate_by_hand(spark):
    y, p = np.array([1.0, 2.0, 4.0, 9.0]), np.array([1.5, 2.0, 3.0, 8.0])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "price double, prediction double")
    row = evaluate(df).first()
    assert row["mse"] == pytest.approx(((y - p) ** 2).mean())
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["baseline"] == 3.0 and row["base_rmse"] == pytest.approx(np.sqrt(((y - 3) ** 2).mean()))
    assert evaluate(df, baseline="mean").first()["baseline"] == 4.0
    board = leaderboard({"good": df, "bad": df.withColumn("prediction", F.lit(0.0))})
    assert [r["model"] for r in board.collect()] == ["good", "bad"]


def test_compare_models(dirty):
    table = prepare([dirty])
    fits = {
        "linear": lambda train: M.fit_linear(train, ignore=["row_key"]),
        "forest": lambda train: M.fit_forest(train, ignore=["row_key"], trees=2, depth=3),
    }
    result = compare_models(table, fits=fits, sample=2000)
    board = result.leaderboard.collect()
    assert {r["model"] for r in board} == {"linear", "forest"}
    assert 120 < board[0]["n"] < 280 and set(result.importances) == {"forest"}


def test_overview(dirty):
    tables = overview(
        prepare([dirty]), ["Brand#1", "Brand#2", "Brand#3"], [("Brand#1", "Brand#2")],
        {"common": ["Brand#1", "Brand#2"], "lux": ["Brand#3"]},
    )
    assert tables["top_make"].count() == 10 and tables["segment_curve"].count() == 122
    assert tables["t_tests"].first()["p"] <= 1
    assert all(df.columns for df in tables.values())


def test_linear_fits_that_do_not_converge_are_refused(signal):
    for fit in (M.fit_linear, M.fit_ridge, M.fit_lasso):
        with pytest.raises(RuntimeError, match="not converged"):
            fit(signal, ignore=["listing_id"], solver="l-bfgs", rounds=1)
    closed, rounds = (M.fit_linear(signal, ignore=["listing_id"], solver=s) for s in ("normal", "l-bfgs"))
    pairs = zip(*[M.predict(m, signal).orderBy("listing_id").select("prediction").collect() for m in (closed, rounds)])
    assert all(a[0] == pytest.approx(b[0], rel=1e-5) for a, b in pairs)


def test_solvers_agree_on_penalties(spark):
    df, *_ = small(spark)
    for fit in (M.fit_ridge, M.fit_lasso):
        one, two = (M.predict(fit(df, 0.05, solver=s), df).agg(F.sum(F.abs("prediction"))).first()[0] for s in ("normal", "l-bfgs"))
        assert one == pytest.approx(two, rel=1e-7)


def test_p_values_at_any_size():
    from lotbook.functions.distributions import _regularised_beta, two_sided_p

    # closed forms for 1, 2 and 4 degrees of freedom; the normal law at the other end
    for t in (0.01, 0.5, 1.7, 2.5, 40.0):
        assert two_sided_p(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-9)
        assert two_sided_p(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
        u = t * t / (4 + t * t)
        assert two_sided_p(t, 4) == pytest.approx(1 - math.sqrt(u) * (1.5 - u / 2), rel=1e-6)
    for t in (0.01, 1.0, 1.7, 1.8, 5.0, 20.0):
        assert two_sided_p(t, 1e10) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-5)
        assert two_sided_p(t, 100_000) == pytest.approx(two_sided_p(t, 100_001), rel=1e-3)
    with pytest.raises(ArithmeticError):
        _regularised_beta(0.5, 0.5, 500.0, 0.5, steps=2)


def test_the_compared_models_are_those_of_the_training_run(spark, sf_dir):
    """Boosting, linear and forest, and the importances of the trees."""
    from __spark_entry__ import queries

    rows = queries()["e4_compared_models"](spark, sf_dir).collect()
    assert {(r["model"], r["complete"]) for r in rows} == {("boosting", True), ("linear", True), ("forest", True)}


def test_text_columns_of_a_net_are_looked_up_in_groups():
    """Loss and gradient over combinations of values are those of the dense rows of all slots."""
    from lotbook.operators import network

    rng = np.random.default_rng(3)
    counts, n = [3, 130, 4, 200], 50
    together = network.grouped(counts, 600)
    assert together == [[3, 0], [1, 2]] and network.grouped([5000], 600) == [[0]]
    digits = np.array([rng.integers(0, c, n) for c in counts])
    starts = 1 + np.cumsum([0, *counts])[:-1]
    code = np.array([digits[a] * counts[b] + digits[b] for a, b in together])
    x, y, weight = rng.normal(size=(1, n)), rng.integers(0, 3, n), rng.random(n)
    sizes = [1 + sum(counts), 6, 4, 3]
    scale, shift = rng.random(sizes[0]), rng.random(sizes[0])
    dense = np.zeros((n, sizes[0]))
    dense[:, 0] = x[0]
    for start, d in zip(starts, digits):
        dense[np.arange(n), start + d] = 1
    dense = dense * scale + shift
    weights = rng.normal(size=sum((a + 1) * b for a, b in zip(sizes, sizes[1:])))

    def loss(w):
        z = dense
        for i, (matrix, bias) in enumerate(network.layers_of(w, sizes)):
            z = (z if i == 0 else 1 / (1 + np.exp(-z))) @ matrix + bias
        return -(weight * (z[np.arange(n), y] - np.log(np.exp(z).sum(axis=1)))).sum()

    one = network.Pass(weights, sizes, [[(int(starts[i]), counts[i]) for i in g] for g in together], scale, shift)
    for cut in (slice(0, 20), slice(20, n)):
        one.add(code[:, cut], x[:, cut], y[cut], weight[cut])
    assert one.loss == pytest.approx(loss(weights))
    gradient = one.gradient()
    for i in [*rng.integers(0, sizes[0] * 6, 20), *range(sizes[0] * 6, len(weights))]:
        step = np.zeros(len(weights))
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-5, abs=1e-5)

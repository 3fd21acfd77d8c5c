"""Trees on coded rows: the models of Spark's trainer, in few bytes a row."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lotbook.operators import models as M
from lotbook.operators import trees as T

WIDE = 20


@pytest.fixture(scope="module")
def table(spark):
    """Rows with repeats, nulls among the texts, a text column wider than the bins, a constant and a number of many values."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        make, state, city = rng.integers(9), rng.integers(4), rng.integers(30)
        x, year = float(rng.normal()), int(rng.integers(1990, 1997))
        price = 300.0 * ((make * 7) % 9) + 70.0 * ((city * 11) % 30) + 40 * np.sin(3 * x) + 15 * (year - 1990) * (state + 1) + rng.normal()
        rows.append((f"k{make}" if make else None, f"s{state}", f"c{city}", "one", x, year, float(price), float(np.clip(price // 900, 0, 3))))
    rows += rows[:400]
    return spark.createDataFrame(rows, "make string, state string, city string, same string, x double, year int, price double, band double").repartition(3).localCheckpoint()


def both(monkeypatch, fit):
    """The fit by Spark's trainer and by the coded one."""
    plain = fit()
    monkeypatch.setattr(M, "SPARK_ROWS", 0)
    return plain, fit()


def predicted(model, table):
    return [r["prediction"] for r in M.predict(model, table).orderBy(*[c for c in table.columns]).collect()]


@pytest.mark.parametrize("encoding", ["index", "one_hot"])
def test_boosting_is_that_of_sparks_trainer(table, monkeypatch, encoding):
    rows = table.drop("band")
    one, two = both(monkeypatch, lambda: M.fit_boosting(rows, rounds=12, depth=4, rate=0.3, encoding=encoding, max_bins=WIDE))
    assert predicted(two, rows) == pytest.approx(predicted(one, rows), rel=1e-9)
    # slots that part the rows of a node alike have equal gains, but for the order of sums
    assert two.stages[-1].featureImportances.toArray() == pytest.approx(one.stages[-1].featureImportances.toArray(), abs=1e-3)
    assert two.stages[-1].treeWeights == one.stages[-1].treeWeights and two.stages[-1].numFeatures == one.stages[-1].numFeatures
    assert [(t.numNodes, t.depth) for t in two.stages[-1].trees] == [(t.numNodes, t.depth) for t in one.stages[-1].trees]
    first, second = ({r["feature"]: r["weight"] for r in M.importances(m, rows).collect()} for m in (one, two))
    assert second == pytest.approx(first, abs=1e-3)


@pytest.mark.parametrize("encoding", ["index", "one_hot"])
def test_band_tree_is_that_of_sparks_trainer(table, monkeypatch, encoding):
    """Categories few enough for all subsets, categories in order, and four classes; two classes too."""
    for rows in (table, table.withColumn("band", (F.col("band") > 1).cast("double"))):
        monkeypatch.setattr(M, "SPARK_ROWS", 1_000_000)
        one, two = both(monkeypatch, lambda: M.fit_band_tree(rows, depth=5, encoding=encoding, max_bins=32))
        assert predicted(two, rows) == predicted(one, rows)
        assert two.stages[-1].numClasses == one.stages[-1].numClasses
        assert two.stages[-1].featureImportances.toArray() == pytest.approx(one.stages[-1].featureImportances.toArray(), abs=1e-9)
        probabilities = [m.transform(rows).orderBy(*rows.columns).select("probability").collect() for m in (one, two)]
        assert np.allclose(*[[r[0].toArray() for r in p] for p in probabilities])


def test_forest_is_as_good_repeats_and_draws_for_each_tree(table, monkeypatch):
    rows = table.drop("band")
    one, two = both(monkeypatch, lambda: M.fit_forest(rows, trees=6, depth=6, max_bins=WIDE))
    again = M.fit_forest(rows, trees=6, depth=6, max_bins=WIDE)
    price = [r["price"] for r in rows.orderBy(*rows.columns).collect()]
    errors = [np.mean((np.array(predicted(m, rows)) - price) ** 2) for m in (one, two, again)]
    assert errors[1] == pytest.approx(errors[0], rel=0.15) and errors[2] == errors[1]
    assert len({t.toDebugString.split("\n", 1)[1] for t in two.stages[-1].trees}) == 6
    drawn = [t._call_java("rootNode").impurityStats().rawCount() for t in two.stages[-1].trees]
    assert all(abs(d - 3400) < 300 for d in drawn) and len(set(drawn)) > 1


def test_grid_on_coded_rows(table, monkeypatch):
    rows = table.drop("band").withColumn("key", F.concat_ws("-", "make", "city", "x"))
    grids = []
    for bound in (1_000_000, 0):
        monkeypatch.setattr(M, "SPARK_ROWS", bound)
        grids.append(M.grid_search(rows, "key", grid={"numTrees": [1, 5]}, folds=2, depth=5))
    for (one, best, winner) in grids:
        assert [r["numTrees"] for r in one.collect()] == ["1", "5"] and best["numTrees"] == 5
        assert winner.stages[-1].getNumTrees == 5
    first, second = ([r["mean"] for r in g[0].collect()] for g in grids)
    assert second == pytest.approx(first, abs=0.05)


def test_one_pass_or_many_and_few_bytes(table, monkeypatch):
    """Nodes that do not fit into one pass are dealt with in more; a row takes a byte a column, and its label."""
    monkeypatch.setattr(M, "SPARK_ROWS", 0)
    rows = table.drop("band")
    made = []
    real = T.code
    monkeypatch.setattr(T, "code", lambda *a: made.append(real(*a)) or made[-1])
    one = M.fit_boosting(rows, rounds=3, depth=4, encoding="one_hot")
    stored = made[0].rows.collect()
    assert sum(r["n"] for r in stored) == 3400 and sum(len(r["codes"]) + len(r["label"]) for r in stored) == 3400 * (6 + 8)
    monkeypatch.setattr(T, "CELLS", 1000)
    monkeypatch.setattr(T, "BLOCK", 100)
    assert predicted(M.fit_boosting(rows, rounds=3, depth=4, encoding="one_hot"), rows) == pytest.approx(predicted(one, rows), rel=1e-9)
    assert max(r["n"] for r in made[1].rows.collect()) == 100


def test_saved_and_odd_input(table, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SPARK_ROWS", 0)
    rows = table.drop("band")
    model = M.fit_forest(rows, trees=2, depth=3)
    M.save_model(model, str(tmp_path / "m"))
    assert predicted(PipelineModel.load(str(tmp_path / "m")), rows) == predicted(model, rows)
    with pytest.raises(Exception, match="must not be null"):
        M.fit_forest(rows.withColumn("x", F.when(F.col("x") > 0, F.col("x"))), trees=2, depth=3)
    flat = M.fit_boosting(rows.withColumn("price", F.lit(5.0)), rounds=2, depth=3)
    assert set(predicted(flat, rows)) == {5.0}


def test_thresholds_by_hand():
    assert T.thresholds(np.array([3.0, 1, 1, 2]), 5).tolist() == [1.5, 2.5]
    assert T.thresholds(np.array([7.0, 7]), 5).tolist() == []
    assert T.thresholds(np.arange(8.0), 3).tolist() == [1.5, 3.5, 5.5]


def test_boosted_rows_take_no_memory_between_rounds(spark, signal, monkeypatch):
    """The rows of a round with their scores lie on disk; the model is that of the trainer either way."""
    from lotbook.operators import models as M
    from pyspark import StorageLevel

    levels, kind = [], type(signal)
    real = kind.persist
    monkeypatch.setattr(M, "SPARK_ROWS", 100)
    monkeypatch.setattr(kind, "persist", lambda self, level=StorageLevel.MEMORY_AND_DISK_DESER: levels.append(level) or real(self, level))
    model = M.fit_boosting(signal, ignore=["listing_id"], rounds=3, depth=2)
    assert len(model.stages[-1].trees) == 3
    assert len(levels) == 2 and all(level.useDisk and not level.useMemory for level in levels)

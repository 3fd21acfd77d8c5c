"""Price models. Every ``fit_*`` returns a PipelineModel: feature stages fitted on train rows, then the model.

``ignore`` names columns that are no features (row keys, folds).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.operators import network
from lotbook.operators import trees as T
from lotbook.operators.features import INDEX, feature_names, feature_stages, source_column, tree_features
from lotbook.operators.sampling import sort_by_weight, with_fold
from lotbook.session import shared_dir, staged

SEED = 10
# Of linear models, at any width. The closed form ("normal") is for up to 4,096 features; Spark refuses it beyond.
SOLVER, ROUNDS, TOLERANCE = "l-bfgs", 1000, 1e-12
MAX_DEPTH = 30  # of Spark's trees
# Of the input of trees in a file. Spark keeps these rows as objects of some 330 bytes each; in files they take 10 to 15.
TREE_ROWS = 500_000
# Train rows up to which Spark's trainer keeps them as such objects. More are fitted by ``operators.trees``, as coded bytes.
SPARK_ROWS = 1_000_000


def _depth(depth: int) -> int:
    if depth > MAX_DEPTH:
        raise ValueError(f"Spark grows trees to a depth of {MAX_DEPTH} at most, not {depth}")
    return depth


def fit_model(train: DataFrame, model: Estimator, label: str = "price", ignore: Sequence[str] = (),
              encoding: str = "one_hot", scaled: bool = False) -> PipelineModel:
    """Fit feature stages, then ``model`` on their output."""
    stages = feature_stages(train, label, ignore, encoding, scaled)
    return Pipeline(stages=[*stages, model]).fit(train)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with a prediction column, without the intermediate feature columns."""
    keep = df.columns if keep is None else list(keep)
    return model.transform(df).select(*keep, "prediction")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_linear(train: DataFrame, label: str = "price", ignore: Sequence[str] = (), solver: str = SOLVER,
               rounds: int = ROUNDS) -> PipelineModel:
    """Least squares. Scaling the features would not change its predictions, so none is done."""
    return _fit_least_squares(train, 0.0, 0.0, label, ignore, solver, rounds)


def fit_ridge(train: DataFrame, alpha: float = 1.0, label: str = "price", ignore: Sequence[str] = (), solver: str = SOLVER,
              rounds: int = ROUNDS) -> PipelineModel:
    """Least squares with a squared penalty ``alpha`` on features of unit length.

    Spark divides the error by n and scales the label by its deviation, hence alpha * std.
    """
    spread, rows = train.agg(F.stddev_pop(label), F.count("*")).first()
    return _fit_least_squares(train, alpha * spread * _shrunk(rows, solver), 0.0, label, ignore, solver, rounds)


def fit_lasso(train: DataFrame, alpha: float = 0.1, label: str = "price", ignore: Sequence[str] = (), solver: str = SOLVER,
              rounds: int = ROUNDS) -> PipelineModel:
    """Least squares with an absolute penalty ``alpha`` on features of unit length."""
    rows = train.count()
    return _fit_least_squares(train, alpha * math.sqrt(rows) * _shrunk(rows, solver), 1.0, label, ignore, solver, rounds)


def _shrunk(rows: int, solver: str) -> float:
    """Spark's closed form scales with deviations over n, the other solver with those over n - 1."""
    return 1.0 if solver == "normal" else math.sqrt((rows - 1) / max(rows, 1)) if rows else 0.0


def _fit_least_squares(train: DataFrame, penalty: float, absolute: float, label: str, ignore: Sequence[str], solver: str,
                       rounds: int) -> PipelineModel:
    """The same solver, rounds and tolerance at every width; a fit that has not converged is refused."""
    linear = LinearRegression(
        labelCol=label, regParam=penalty, elasticNetParam=absolute, solver=solver, tol=TOLERANCE, maxIter=rounds
    )
    model = fit_model(train, linear, label, ignore)
    if model.stages[-1].summary.totalIterations >= rounds:
        raise RuntimeError(f"the linear model has not converged after {rounds} rounds of {solver}")
    return model


def fit_forest(train: DataFrame, label: str = "price", ignore: Sequence[str] = (), trees: int = 500,
               depth: int = 10, encoding: str = "index", max_bins: int = 64, seed: int = SEED) -> PipelineModel:
    """Random forest over all features; a depth beyond Spark's limit is refused."""
    forest = RandomForestRegressor(
        labelCol=label, numTrees=trees, maxDepth=_depth(depth), featureSubsetStrategy="all", seed=seed,
        maxMemoryInMB=1024,
    )
    return _fit_trees(train, forest, label, ignore, encoding, max_bins)


def fit_boosting(train: DataFrame, label: str = "price", ignore: Sequence[str] = (), rounds: int = 1500,
                 depth: int = 5, rate: float = 0.01, encoding: str = "index", max_bins: int = 64,
                 seed: int = SEED) -> PipelineModel:
    """Gradient boosted trees on squared error; the running errors are checkpointed every ten rounds."""
    boosting = GBTRegressor(
        labelCol=label, maxIter=rounds, maxDepth=_depth(depth), stepSize=rate, lossType="squared", seed=seed,
        maxMemoryInMB=1024, checkpointInterval=10,
    )
    return _fit_trees(train, boosting, label, ignore, encoding, max_bins, remember=False)


def _fit_trees(train: DataFrame, trees: Estimator, label: str, ignore: Sequence[str], encoding: str,
               max_bins: int, remember: bool = True) -> PipelineModel:
    """Feature stages, then trees. The bins are as many as asked for, however wide the text columns are.

    The features are written once, as every level of a tree reads them. ``remember``: rows keep the node they are in, instead of
    walking down again for every level, which pays for deep trees only. Above ``SPARK_ROWS`` the rows are coded instead.
    """
    shared_dir(train.sparkSession)  # boosting and the remembered nodes write checkpoints
    trees.setMaxBins(max_bins)
    trees.setCacheNodeIds(remember)
    trees.setCheckpointInterval(10)
    features, ready = _tree_input(train, label, ignore, encoding, max_bins)
    if _large(train, [trees]):
        inputs = _coded_inputs(features)
        rows = staged(ready.select(label, *[F.col(f"`{name}`") for name, *_ in inputs]), "tree-columns")
        return PipelineModel([*features.stages, *_fit_coded(trees, [{}], rows, inputs, label)])
    return PipelineModel([*features.stages, trees.fit(staged(ready.select(label, "features"), "tree-input", TREE_ROWS))])


def _large(train: DataFrame, models: Sequence[Estimator]) -> bool:
    return all(T.fits(m) for m in models) and train.count() > SPARK_ROWS


def _coded_inputs(features: PipelineModel) -> list[tuple[str, str, int]]:
    """(column, kind, number of categories) of what the assembler puts together, before one-hot slots are made of it."""
    sizes, slots = {}, {}
    for stage in features.stages:
        if isinstance(stage, StringIndexerModel):
            sizes = {c: len(labels) + 1 for c, labels in zip(stage.getOutputCols(), stage.labelsArray)}
        elif isinstance(stage, OneHotEncoderModel):
            slots = {out: (c, T.ONE_HOT, size) for out, c, size in zip(stage.getOutputCols(), stage.getInputCols(), stage.categorySizes)}
    return [
        slots.get(c) or ((c, T.CATEGORY, sizes[c]) if c in sizes and c.endswith(INDEX) else (c, T.NUMBER, 0))
        for c in features.stages[-1].getInputCols()
    ]


def _fit_coded(model: Estimator, sets: Sequence[dict], rows: DataFrame, inputs: Sequence[tuple[str, str, int]], label: str) -> list[Model]:
    """``model`` with each set of parameters, on rows that are coded once for each number of bins."""
    coded: dict[int, T.Coded] = {}
    fitted = []
    for one in sets:
        chosen = model.copy(one)
        bins = chosen.getMaxBins()
        if bins not in coded:
            classes = _classes(rows, label) if isinstance(chosen, DecisionTreeClassifier) else 0
            coded[bins] = T.code(rows, inputs, label, bins, chosen.getSeed(), classes)
        fitted.append(T.fit(chosen, coded[bins]))
    return fitted


def _classes(rows: DataFrame, label: str) -> int:
    """As many as the column says it has, else up to the largest label."""
    about = rows.schema[label].metadata.get("ml_attr", {})
    found = len(about.get("vals", ())) or about.get("num_vals")
    return found or int(rows.agg(F.max(label)).first()[0]) + 1


def _tree_input(train: DataFrame, label: str, ignore: Sequence[str], encoding: str, max_bins: int,
                fold: Column | None = None) -> tuple[PipelineModel, DataFrame]:
    if encoding == "index":
        return tree_features(train, label, ignore, max_bins, fold)
    features = Pipeline(stages=feature_stages(train, label, ignore, encoding)).fit(train)
    return features, features.transform(train)


def fit_band_tree(train: DataFrame, bands: str = "band", ignore: Sequence[str] = ("price",), depth: int = 10,
                  encoding: str = "index", max_bins: int = 64, seed: int = SEED) -> PipelineModel:
    """Decision tree for price bands, split by entropy."""
    tree = DecisionTreeClassifier(labelCol=bands, impurity="entropy", maxDepth=_depth(depth), seed=seed)
    return _fit_trees(train, tree, bands, ignore, encoding, max_bins)


def fit_band_net(train: DataFrame, n_bands: int, bands: str = "band", ignore: Sequence[str] = ("price",),
                 hidden: Sequence[int] = (64, 32), rounds: int = 75, block: int = 100, seed: int = SEED) -> PipelineModel:
    """Dense network for price bands on features scaled to [0, 1], with sigmoid layers.

    ``operators.network`` finds the weights over rows of slot numbers; ``block`` rows are averaged first, as Spark does.
    """
    stages = feature_stages(train, bands, ignore, scaled=True)
    features = Pipeline(stages=stages).fit(train)
    coded = next((s for s in features.stages if isinstance(s, OneHotEncoderModel)), None)
    names = [c for c in stages[-2].getInputCols() if coded is None or c not in coded.getOutputCols()]
    columns = list(coded.getInputCols()) if coded else []
    counts = [int(n) for n in coded.categorySizes] if coded else []
    starts = [len(names) + sum(counts[:i]) for i in range(len(counts))]
    together = network.grouped(counts)
    groups = [[(starts[i], counts[i]) for i in group] for group in together]
    places = []
    for g, group in enumerate(together):
        place = F.lit(0.0)
        for i in group:
            place = place * counts[i] + F.col(f"`{columns[i]}`")
        places.append(place.alias(f"_group{g}"))
    low, high = (np.asarray(v.toArray()) for v in (features.stages[-1].originalMin, features.stages[-1].originalMax))
    # slots of one value are 0.5, as the scaler has it
    spread = high > low
    scale = np.where(spread, 1 / np.where(spread, high - low, 1), 0.0)
    shift = np.where(spread, -low * scale, 0.5)
    ready = PipelineModel(features.stages[:1] if coded else []).transform(train)
    used = ready.select(*places, *[F.col(f"`{c}`") for c in names], bands)
    rows = network.blocks(used, [f"_group{g}" for g in range(len(groups))], names, bands, n_bands, block)
    sizes = [len(low), *hidden, n_bands]
    net = MultilayerPerceptronClassifier(labelCol=bands, layers=sizes, maxIter=0, blockSize=block, seed=seed)
    one = features.transform(train.limit(1))
    start = net.fit(one).weights.toArray()  # as drawn from the seed; no round is made
    weights = network.minimize(network.objective(staged(rows, "net-rows"), sizes, groups, scale, shift, block), start, rounds)
    fitted = net.copy({net.initialWeights: Vectors.dense(weights)}).fit(one)
    return PipelineModel([*features.stages, fitted.copy({fitted.maxIter: rounds})])


@dataclass
class Grid:
    """Parameter sets by fold: ``scores`` has a row (set, fold, n_rows, score) for each; ``rows``: label, features, fold."""

    features: PipelineModel
    rows: DataFrame
    model: Estimator
    sets: list[dict]
    names: list[str]
    scores: list[tuple[int, int, int, float]]
    inputs: list[tuple[str, str, int]] | None  # of rows too many for Spark's trainer: the columns to code, which ``rows`` has too
    label: str

    def named(self, i: int) -> dict:
        return {n: self.sets[i][self.model.getParam(n)] for n in self.names}

    def fit(self, i: int) -> Model:
        """The model of a set, fitted on all rows."""
        if self.inputs:
            return _fit_coded(self.model, [self.sets[i]], self.rows, self.inputs, self.label)[0]
        return self.model.copy(self.sets[i]).fit(self.rows)


def cross_validate(train: DataFrame, key: str, label: str = "price", ignore: Sequence[str] = (),
                   grid: Mapping[str, Sequence] | None = None, model: Estimator | None = None, folds: int = 5,
                   encoding: str = "index", metric: str = "r2", parallelism: int = 2,
                   max_bins: int = 64, depth: int = 10) -> Grid:
    """Fit every parameter set on the other folds, and score all sets of a fold together.

    The rows of a fold get the predictions of all its models side by side, and one aggregate gives all their scores, so the
    number of passes for scoring does not depend on the number of sets. Folds follow from the row key; target statistics of wide
    text columns use the same folds.
    """
    shared_dir(train.sparkSession)
    folded = with_fold(train, folds, key, name="_part")
    # encoders need no label, so they are fitted once, not for every fold and set
    features, ready = _tree_input(folded, label, [key, "_part", *ignore], encoding, max_bins, F.col("_part"))
    if model is None:
        model = RandomForestRegressor(labelCol=label, featureSubsetStrategy="all", seed=SEED, maxDepth=_depth(depth))
    if model.hasParam("maxBins"):
        model = model.copy({model.getParam("maxBins"): max_bins})
    grid = grid or {"numTrees": [200, 500]}
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), list(values))
    sets = builder.build()
    inputs = _coded_inputs(features) if _large(train, [model.copy(s) for s in sets]) else None
    more = [F.col(f"`{name}`") for name, *_ in inputs or ()]
    rows = staged(ready.select(label, "features", F.col("_part").alias("fold"), *more), "folds", TREE_ROWS)
    scores = []
    for fold in range(folds):
        others = rows.where(F.col("fold") != fold)
        fitted: list = [None] * len(sets)
        if inputs:
            fitted = _fit_coded(model, sets, others, inputs, label)
        else:
            # taken up by threads of one pool, as many fits at a time as asked for
            tasks = model.fitMultiple(others, sets)
            with ThreadPool(min(parallelism, len(sets))) as pool:
                for i, one in pool.imap_unordered(lambda _: next(tasks), range(len(sets))):
                    fitted[i] = one
        scores += [(i, fold, n, s) for i, (n, s) in enumerate(_scores(fitted, rows.where(F.col("fold") == fold), label, metric))]
    return Grid(features, rows, model, sets, list(grid), scores, inputs, label)


def _scores(fitted: Sequence[Model], rows: DataFrame, label: str, metric: str) -> list[tuple[int, float]]:
    """Rows and score of each model, from one aggregate over predictions that stand side by side."""
    for i, model in enumerate(fitted):
        model = model.copy({model.getParam("predictionCol"): f"_p{i}"})
        for more in ("rawPredictionCol", "probabilityCol"):  # of class models; not needed
            if model.hasParam(more):
                model.set(model.getParam(more), "")
        rows = model.transform(rows)
    y = F.col(label).cast("double")
    errors = [y - F.col(f"_p{i}") for i in range(len(fitted))]
    sums = rows.agg(
        F.count(y).alias("n"), F.var_pop(y).alias("v"),
        *[F.avg(e * e).alias(f"mse{i}") for i, e in enumerate(errors)],
        *[F.avg(F.abs(e)).alias(f"mae{i}") for i, e in enumerate(errors)],
    ).first()
    found = []
    for i in range(len(fitted)):
        mse, mae = sums[f"mse{i}"], sums[f"mae{i}"]
        if mse is None:
            raise ValueError("a fold without rows: fewer folds, or more rows")
        r2 = 1 - mse / sums["v"] if sums["v"] else math.nan
        found.append((sums["n"], {"mse": mse, "rmse": math.sqrt(mse), "mae": mae, "r2": r2}[metric]))
    return found


def grid_search(train: DataFrame, key: str, label: str = "price", ignore: Sequence[str] = (),
                grid: Mapping[str, Sequence] | None = None, model: Estimator | None = None, folds: int = 5,
                encoding: str = "index", metric: str = "r2", parallelism: int = 2,
                max_bins: int = 64, depth: int = 10) -> tuple[DataFrame, dict, PipelineModel]:
    """Cross-validated score of every parameter set (mean and std over folds), the best set, and the model fitted with it
    on all rows, feature stages included.

    By default a random forest over all features is searched for its number of trees.
    """
    found = cross_validate(train, key, label, ignore, grid, model, folds, encoding, metric, parallelism, max_bins, depth)
    by_set = [[s for i, _, _, s in found.scores if i == n] for n in range(len(found.sets))]
    means = [sum(scores) / len(scores) for scores in by_set]
    rows = [
        (*[str(v) for v in found.named(i).values()], mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)))
        for i, (scores, mean) in enumerate(zip(by_set, means))
    ]
    table = train.sparkSession.createDataFrame(rows, ", ".join([*[f"`{n}` string" for n in found.names], "mean double", "std double"]))
    pick = max if metric == "r2" else min
    best = pick(range(len(means)), key=lambda i: means[i])
    winner = PipelineModel([*found.features.stages, found.fit(best)])
    return table, found.named(best), winner


def fold_scores(train: DataFrame, key: str, **settings) -> DataFrame:
    """The parameters of each set, fold, n_rows, score: what ``grid_search`` averages. ``settings`` as there."""
    found = cross_validate(train, key, **settings)
    rows = [(*[str(v) for v in found.named(i).values()], fold, n, float(score)) for i, fold, n, score in found.scores]
    names = ", ".join([*[f"`{n}` string" for n in found.names], "fold int", "n_rows bigint", "score double"])
    return train.sparkSession.createDataFrame(rows, names)


def importances(model: PipelineModel, train: DataFrame, per_column: bool = False) -> DataFrame:
    """feature, weight: importance of each slot (or of each table column), heaviest first."""
    names = feature_names(PipelineModel(model.stages[:-1]).transform(train.limit(1)))
    weights = model.stages[-1].featureImportances.toArray()
    table = train.sparkSession.createDataFrame(
        [(n, float(w)) for n, w in zip(names, weights)], "feature string, weight double"
    )
    if per_column:
        owner = {n: source_column(n, train.columns) for n in names}
        columns = train.sparkSession.createDataFrame(list(owner.items()), "feature string, column string")
        table = (
            table.join(columns, "feature").groupBy("column").agg(F.sum("weight").alias("weight"))
            .withColumnRenamed("column", "feature")
        )
    return sort_by_weight(table)

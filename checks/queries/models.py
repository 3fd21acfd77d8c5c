"""Feature vectors and price models. Quality is compared on the listings whose price has a signal."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.queries.statistics import SIGNAL, rounded
from checks.registry import query
from checks.views import price_signal
from lotbook.operators import models as M
from lotbook.operators.evaluate import constant_predictions, evaluate, leaderboard
from lotbook.operators.features import feature_names, feature_stages, price_bands
from lotbook.operators.sampling import split
from lotbook.session import scratch_path, staged
from lotbook.streaming.score import score_stream

KEY = "listing_id"
USED = [KEY, "price", "make", "model", "body_style", "city", "state", "color", "year", "mileage"]
TEST = "md5(concat(listing_id, ':10')) < '33333333333333333333333333333333'"


def train_test(spark, sf_dir):
    """Written once: fitting reads the train rows several times."""
    return split(staged(price_signal(spark, sf_dir).select(*USED), "signal"), 0.2, KEY)


# --- models of one feature have a closed form, so that SQL can check fit and prediction ---------------

ONE_FEATURE = f"""{SIGNAL}, train as (select * from price_signal where not ({TEST})),
    m as (select count(*) as n, avg(mileage) as mx, avg(price) as my, regr_sxx(price, mileage) as sxx, regr_sxy(price, mileage) as sxy from train)"""


def _one_feature(spark, sf_dir):
    train, test = split(price_signal(spark, sf_dir).select(KEY, "price", "mileage"), 0.2, KEY)
    return train, test


def _line(model, rows):
    """Slope and intercept next to the number of rows, from the fitted model."""
    fitted = model.stages[-1]
    return rounded(
        rows.agg(F.count("*").alias("n")).select(
            "n", F.lit(float(fitted.coefficients[0])).alias("slope"), F.lit(float(fitted.intercept)).alias("intercept")
        ),
        "slope", "intercept", digits=3,
    )


@query(
    "m1_linear_one_feature",
    f"{ONE_FEATURE} select n, round(sxy / sxx, 3) as slope, round(my - sxy / sxx * mx, 3) as intercept from m",
)
def linear_one_feature(spark, sf_dir):
    train, _ = _one_feature(spark, sf_dir)
    return _line(M.fit_linear(train, ignore=[KEY]), train)


@query(
    "m2_ridge_one_feature",
    f"{ONE_FEATURE} select n, round(sxy / sxx / 2, 3) as slope, round(my - sxy / sxx / 2 * mx, 3) as intercept from m",
)
def ridge_one_feature(spark, sf_dir):
    train, _ = _one_feature(spark, sf_dir)
    return _line(M.fit_ridge(train, 1.0, ignore=[KEY]), train)


@query(
    "m3_lasso_one_feature",
    f"""{ONE_FEATURE}, l as (select *, sign(sxy) * greatest(abs(sxy) / sqrt(sxx) - n * 0.5, 0) / sqrt(sxx) as slope from m)
    select n, round(slope, 3) as slope, round(my - slope * mx, 3) as intercept from l""",
)
def lasso_one_feature(spark, sf_dir):
    train, _ = _one_feature(spark, sf_dir)
    return _line(M.fit_lasso(train, 0.5, ignore=[KEY]), train)


@query(
    "m10_predict",
    f"""{ONE_FEATURE} select listing_id, round(my + sxy / sxx * (mileage - mx), 2) as prediction from price_signal, m where {TEST}""",
)
def predictions(spark, sf_dir):
    train, test = _one_feature(spark, sf_dir)
    return rounded(M.predict(M.fit_linear(train, ignore=[KEY]), test, [KEY]), "prediction", digits=2)


# --- models of all features ---------------------------------------------------------------------------


TEXT_SLOTS = " union all ".join(
    f"select concat('{c}_', {c}) as feature, count(*) as n_rows from price_signal group by 1"
    for c in ("make", "model", "body_style", "city", "state", "color")
)
NUMBER_SLOTS = " union all ".join(
    f"select '{c}' as feature, count(*) as n_rows from price_signal where {c} <> 0" for c in ("year", "mileage")
)


@query("f3_feature_slots", f"{SIGNAL} {TEXT_SLOTS} union all {NUMBER_SLOTS}")
def feature_slots(spark, sf_dir):
    """How many rows use each slot of the feature vector."""
    rows = price_signal(spark, sf_dir).select(*USED)
    ready = Pipeline(stages=feature_stages(rows, "price", [KEY])).fit(rows).transform(rows)
    names = F.array(*[F.lit(n) for n in feature_names(ready)])
    from pyspark.ml.functions import vector_to_array

    slots = ready.select(F.explode(F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("value"))).alias("s"))
    return slots.where("s.value <> 0").groupBy("s.feature").agg(F.count("*").alias("n_rows"))


def _scored(fit):
    def run(spark, sf_dir):
        train, test = train_test(spark, sf_dir)
        return evaluate(M.predict(fit(train), test))

    return run


AGAINST_BASELINE = f"""{SIGNAL}, test as (select price from price_signal where {TEST}),
    b as (select quantile_cont(price, 0.5) as baseline from test)
    select count(*) as n, round(max(baseline), 4) as baseline, round(sqrt(avg(pow(price - baseline, 2))), 4) as base_rmse,
           true as better from test, b"""


def _against_baseline(fit):
    """The baseline by SQL; of the fit only that it is better than half of the baseline's error."""

    def run(spark, sf_dir):
        scores = _scored(fit)(spark, sf_dir).select("n", "baseline", "base_rmse", (F.col("rmse_ratio") < 0.5).alias("better"))
        return rounded(scores, "baseline", "base_rmse")

    return run


query("m1_linear_against_baseline", AGAINST_BASELINE)(_against_baseline(lambda train: M.fit_linear(train, ignore=[KEY])))
query("m4_forest_against_baseline", AGAINST_BASELINE)(
    _against_baseline(lambda train: M.fit_forest(train, ignore=[KEY], trees=10)))
query("m5_boosting_against_baseline", AGAINST_BASELINE)(
    _against_baseline(lambda train: M.fit_boosting(train, ignore=[KEY], rounds=12, rate=0.3)))
query("m1_linear")(_scored(lambda train: M.fit_linear(train, ignore=[KEY])))
query("m2_ridge")(_scored(lambda train: M.fit_ridge(train, ignore=[KEY])))
query("m3_lasso")(_scored(lambda train: M.fit_lasso(train, ignore=[KEY])))
query("m4_forest")(_scored(lambda train: M.fit_forest(train, ignore=[KEY], trees=10)))
query("m5_boosting")(_scored(lambda train: M.fit_boosting(train, ignore=[KEY], rounds=12, rate=0.3)))


@query("m6_grid_search")
def grid_search(spark, sf_dir):
    train, _ = train_test(spark, sf_dir)
    return M.grid_search(train, KEY, grid={"numTrees": [2, 4]}, folds=5, depth=6)[0]


def _band_scores(fit, n_bands: int):
    def run(spark, sf_dir):
        train, test = train_test(spark, sf_dir)
        banded, edges = price_bands(train, n_bands)
        model = fit(banded)
        scored = M.predict(model, price_bands(test, edges=edges)[0])
        return scored.groupBy("band", "prediction").agg(F.count("*").alias("n_rows"))

    return run


query("m7_band_tree")(_band_scores(lambda train: M.fit_band_tree(train, ignore=[KEY, "price"]), 5))
query("m8_band_net")(
    _band_scores(lambda train: M.fit_band_net(train, 5, ignore=[KEY, "price"], hidden=(32,), rounds=60), 5)
)


@query("m9_importances")
def importances(spark, sf_dir):
    train, _ = train_test(spark, sf_dir)
    model = M.fit_boosting(train, ignore=[KEY], rounds=10, rate=0.2, encoding="one_hot")
    return M.importances(model, train)


@query("m9_importances_by_column")
def importances_by_column(spark, sf_dir):
    train, _ = train_test(spark, sf_dir)
    model = M.fit_forest(train, ignore=[KEY], trees=5, depth=8)
    return M.importances(model, train, per_column=True)


@query("m12_leaderboard")
def model_leaderboard(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    models = {
        "linear": M.fit_linear(train, ignore=[KEY]),
        "forest": M.fit_forest(train, ignore=[KEY], trees=5, depth=8),
        "boosting": M.fit_boosting(train, ignore=[KEY], rounds=10, rate=0.3),
    }
    return leaderboard({name: M.predict(model, test) for name, model in models.items()})


# --- closed forms of trees, grids, bands and boards ----------------------------------------------------

PLAIN = f"{SIGNAL}, train as (select * from price_signal where not ({TEST})), test as (select * from price_signal where {TEST})"


@query(
    "m10_stream_predict",
    f"""{ONE_FEATURE} select listing_id, round(my + sxy / sxx * (mileage - mx), 2) as prediction from price_signal, m where {TEST}""",
)
def stream_predictions(spark, sf_dir):
    """A saved model predicts the rows of files that arrive in four triggers."""
    train, test = _one_feature(spark, sf_dir)
    model, source, out, marks = (scratch_path(spark, n) for n in ("model", "arriving", "predicted", "marks"))
    M.save_model(M.fit_linear(train, ignore=[KEY]), model)
    test.select(KEY, "mileage").repartition(4).write.csv(source)
    schema = T.StructType.fromDDL(f"{KEY} string, mileage double")
    score_stream(spark, model, source, out, marks, schema, [KEY], files_per_trigger=1).awaitTermination()
    return rounded(spark.read.parquet(out), "prediction", digits=2)


MAKE_MEANS = f"{PLAIN}, p as (select make, avg(price) as prediction from train group by 1)"


def _one_round(train):
    """One tree that is deep enough for a leaf for each make."""
    return M.fit_boosting(train, ignore=[KEY], rounds=1, depth=12, rate=1.0)


@query("m5_boosting_one_round", f"{MAKE_MEANS} select listing_id, round(prediction, 3) as prediction from test join p using (make)")
def boosting_one_round(spark, sf_dir):
    """A boosted tree of one categorical feature and one round gives the mean of each make."""
    train, test = train_test(spark, sf_dir)
    model = _one_round(train.select(KEY, "price", "make"))
    return rounded(M.predict(model, test.select(KEY, "make")), "prediction", digits=3).select(KEY, "prediction")


FOLD = "cast(('0x' || substr(md5(concat(listing_id, ':10')), 1, 8)) as bigint) % 5"


@query(
    "m6_grid_folds",
    f"""{PLAIN}, sets as (select unnest(['2', '4']) as "numTrees")
    select "numTrees", cast({FOLD} as int) as fold, count(*) as n_rows, true as better from train, sets group by all""",
)
def grid_folds(spark, sf_dir):
    """Parameter sets by fold, all text columns among the features; every set is better than the mean (r2 above 0.5)."""
    train, _ = train_test(spark, sf_dir)
    scores = M.fold_scores(train, KEY, grid={"numTrees": [2, 4]}, folds=5, depth=6)
    return scores.select("numTrees", "fold", "n_rows", (F.col("score") > 0.5).alias("better"))


@query(
    "a16_scores_by_parameter_set",
    f"""{PLAIN}, f as (select cast({FOLD} as int) as fold, mileage as x, price as y from train),
    a as (select stddev_samp(y) as penalty from f),
    l as (select k.fold, regr_slope(y, x) as b, avg(y) as my, avg(x) as mx, stddev_pop(y) as sd
          from f join (select distinct fold from f) k on f.fold <> k.fold group by 1),
    s as (select f.fold, 1 - avg(pow(y - (my + b * (x - mx)), 2)) / var_pop(y) as plain,
              1 - avg(pow(y - (my + b / (1 + penalty / sd) * (x - mx)), 2)) / var_pop(y) as halved
          from f join l using (fold), a group by f.fold),
    r as (select '0.0' as "regParam", plain as score from s union all select 'half', halved from s)
    select "regParam", round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std from r group by 1""",
)
def scores_by_parameter_set(spark, sf_dir):
    """Least squares of one feature without and with a penalty: mean and deviation of r2 over the folds.

    Spark scales the label by its deviation, so a penalty of that size about halves the slope.
    """
    train, _ = _one_feature(spark, sf_dir)
    spread = train.agg(F.stddev_samp("price")).first()[0]
    model = LinearRegression(labelCol="price", solver="normal")
    table = M.grid_search(train, KEY, grid={"regParam": [0.0, spread]}, model=model, encoding="one_hot", folds=5)[0]
    named = table.withColumn("regParam", F.when(F.col("regParam") == "0.0", "0.0").otherwise("half"))
    return rounded(named, "mean", "std", digits=6)


query("m6_winner_predicts", AGAINST_BASELINE)(
    _against_baseline(lambda train: M.grid_search(train, KEY, grid={"numTrees": [2, 4]}, folds=3, depth=10)[2]))


BAND_EDGES = [25000.0, 30000.0, 35000.0]
BANDED = "cast(case when price < 25000 then 0 when price < 30000 then 1 when price < 35000 then 2 else 3 end as double)"


@query(
    "m7_band_tree_one_feature",
    f"""{PLAIN}, c as (select make, {BANDED} as band, count(*) as n from train group by 1, 2),
    p as (select make, arg_max(band, (n, -band)) as prediction from c group by 1)
    select {BANDED} as band, prediction, count(*) as n_rows from test join p using (make) group by 1, 2""",
)
def band_tree_one_feature(spark, sf_dir):
    """An entropy tree of one categorical feature gives the band that most train rows of a make are in."""
    train, test = train_test(spark, sf_dir)
    banded = price_bands(train, edges=BAND_EDGES)[0].select(KEY, "price", "make", "band")
    model = M.fit_band_tree(banded, ignore=[KEY, "price"], depth=16)
    scored = M.predict(model, price_bands(test, edges=BAND_EDGES)[0], ["band"])
    return scored.groupBy("band", "prediction").agg(F.count("*").alias("n_rows"))


@query(
    "m8_band_net_accuracy",
    f"""{PLAIN}, m as (select {BANDED} as band, count(*) as n from train group by 1),
    top as (select arg_max(band, n) as band from m)
    select count(*) as n_rows, count(*) filter ({BANDED} = top.band) as hits_of_most_frequent, true as better from test, top""",
)
def band_net_accuracy(spark, sf_dir):
    """A network on bands: it hits at least one and a half times as many rows as the most frequent band does."""
    train, test = train_test(spark, sf_dir)
    banded = price_bands(train, edges=BAND_EDGES)[0]
    model = M.fit_band_net(banded, 4, ignore=[KEY, "price"], hidden=(32,), rounds=60)
    most = banded.groupBy("band").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "band").first()["band"]
    scored = M.predict(model, price_bands(test, edges=BAND_EDGES)[0], ["band"])
    counts = scored.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("band") == most).alias("hits_of_most_frequent"),
        F.count_if(F.col("band") == F.col("prediction")).alias("hits"),
    )
    return counts.select("n_rows", "hits_of_most_frequent", (F.col("hits") >= 1.5 * F.col("hits_of_most_frequent")).alias("better"))


@query(
    "m9_importance_of_one_column",
    f"""{PLAIN}, c as (select unnest(['make', 'body_style', 'color', 'mileage', 'year']) as feature)
    select feature, case when feature = 'make' then 1.0 else 0.0 end as weight from c""",
)
def importance_of_one_column(spark, sf_dir):
    """All weight is on the one column that the label depends on."""
    train, _ = train_test(spark, sf_dir)
    rows = train.select(KEY, "make", "body_style", "color", "mileage", "year").withColumn("price", F.substring("make", 7, 9).cast("double"))
    return M.importances(M.fit_boosting(rows, ignore=[KEY], rounds=3, rate=0.5, depth=6), rows)


@query(
    "m12_leaderboard_closed_forms",
    f"""{MAKE_MEANS}, l as (select regr_slope(price, mileage) as b, regr_intercept(price, mileage) as a from train),
    q as (select quantile_cont(price, 0.5) as baseline from test),
    e as (select 'make means' as model, price, prediction from test join p using (make)
          union all select 'line', price, a + b * mileage from test, l
          union all select 'constant', price, baseline from test, q)
    select model, count(*) as n, round(sqrt(avg(pow(price - prediction, 2))), 3) as rmse, round(max(baseline), 3) as baseline,
           round(sqrt(avg(pow(price - baseline, 2))), 3) as base_rmse, cast(row_number() over (order by avg(pow(price - prediction, 2))) as int) as place
    from e, q group by 1""",
)
def leaderboard_closed_forms(spark, sf_dir):
    """Models with a closed form in the order of their errors, next to the constant baseline."""
    train, test = train_test(spark, sf_dir)
    models = {
        "make means": _one_round(train.select(KEY, "price", "make")),
        "line": M.fit_linear(train.select(KEY, "price", "mileage"), ignore=[KEY]),
    }
    predicted = {name: M.predict(model, test, ["price"]) for name, model in models.items()}
    board = leaderboard({**predicted, "constant": constant_predictions(test.select("price"), "price")}, rows=test)
    placed = board.select("model", "n", "rmse", "baseline", "base_rmse", F.lit(1).alias("_one"))
    order = Window.partitionBy("_one").orderBy("rmse")  # three rows
    return rounded(placed.withColumn("place", F.row_number().over(order)).drop("_one"), "rmse", "baseline", "base_rmse", digits=3)


def _normal_equations(columns: list[str]) -> str:
    """Coefficients of two centred features, from the normal equations."""
    a, b = columns
    return f"""c as (select avg({a}) as ma, avg({b}) as mb, avg(price) as my, covar_pop({a}, {a}) as saa, covar_pop({b}, {b}) as sbb,
        covar_pop({a}, {b}) as sab, covar_pop({a}, price) as say, covar_pop({b}, price) as sby, count(*) as n from train)"""


@query(
    "m1_linear_two_features",
    f"""{PLAIN}, {_normal_equations(['mileage', 'year'])},
    w as (select *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) as wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) as wb from c)
    select n, round(wa, 3) as mileage, round(wb, 3) as year, round(my - wa * ma - wb * mb, 1) as intercept from w""",
)
def linear_two_features(spark, sf_dir):
    train, _ = train_test(spark, sf_dir)
    rows = train.select(KEY, "price", "year", "mileage")
    fitted = M.fit_linear(rows, ignore=[KEY]).stages[-1]
    by_name = dict(zip(["year", "mileage"], map(float, fitted.coefficients)))
    table = rows.agg(F.count("*").alias("n")).select(
        "n", *[F.lit(by_name[c]).alias(c) for c in ("mileage", "year")], F.lit(float(fitted.intercept)).alias("intercept")
    )
    return rounded(rounded(table, "mileage", "year", digits=3), "intercept", digits=1)

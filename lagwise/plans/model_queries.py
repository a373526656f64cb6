"""Queries that fit models on games and vectors; most have no SQL and are tested with
NumPy or by held-out quality."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lagwise.operators import blend, boosting, ensemble, importance, metrics, models, network, selection, splits
from lagwise.sources import sinks
from lagwise.staging import shared_dir, stage

from . import views as v
from .player_queries import _SIDE_COLS, game_table
from .registry import query_into, r

Q: dict = {}
SQL: dict[str, str] = {}
query = query_into(Q, SQL)
FEATURES = ["delta_form", *[f"delta_{c}" for c in _SIDE_COLS]]


@query(f"""WITH {v.GAMES}, s AS (SELECT *, CASE WHEN season <= 1998 THEN 'train' WHEN season <= 1999 THEN 'val' ELSE 'test' END AS split, coalesce(delta_form, 0) AS f FROM games),
m AS (SELECT avg(f) FILTER (split = 'train') AS a, stddev_pop(f) FILTER (split = 'train') AS b, avg(home_form) FILTER (split = 'train') AS c, stddev_pop(home_form) FILTER (split = 'train') AS e FROM s)
SELECT game, split, round((f - a) / b, 6) AS delta_form, round(coalesce((home_form - c) / e, 0), 6) AS home_form FROM s, m""")
def scale_fit_train(spark, d):
    g = v.games(spark, d).withColumn("split", splits.chrono_split("season", 1998, 1999)).fillna(0.0, ["delta_form"])
    return models.scale_by_train(g, ["delta_form", "home_form"]).select("game", "split", r("delta_form").alias("delta_form"), r("home_form").alias("home_form"))


def training(spark, d):
    """game, position, split, label and standardised features of every game."""
    g = game_table(spark, d).fillna(0.0, ["delta_form"])
    g = g.withColumn("split", splits.chrono_split("season", 1998, 1999)).withColumn("label", F.col("home_win").cast("double"))
    return splits.positions(g.select("game", "date", "split", "label", *FEATURES), "date", ["game"])


def _parts(spark, d):
    """training, written once as it is read by every fit, and its train and test rows."""
    raw = stage(training(spark, d))
    t = models.assemble(models.scale_by_train(raw, FEATURES), FEATURES)
    return t, t.where("split = 'train'"), t.where("split = 'test'")


def _scored(df, model):
    return models.chance(df, model).select("game", "split", F.col("label").cast("int").alias("label"), F.round("p", 6).alias("p"))


@query()
def pca_embeddings(spark, d):
    """Four components of the vectors, standardised and fitted on all of them."""
    e = v.table(spark, d, "embeddings").withColumn("x", array_to_vector(F.transform("embedding", lambda f: f.cast("double"))))
    out, _ = models.pca_by_train(e, "x", 4, F.lit(True))
    return out.select("vec_id", *[F.round(f"pca_{i}", 6).alias(f"pca_{i}") for i in range(1, 5)])


@query()
def lr_fit(spark, d):
    t, train, _ = _parts(spark, d)
    return _scored(t, models.logistic(0.1, train.count()).fit(train))


@query()
def gbt_fit(spark, d):
    t, train, _ = _parts(spark, d)
    return _scored(t, models.trees(maxIter=10, maxDepth=3, stepSize=0.1, subsamplingRate=0.85).fit(train))


@query()
def mlp_fit(spark, d):
    t, train, _ = _parts(spark, d)
    return _scored(t, models.perceptron(len(FEATURES), (8,), maxIter=50).fit(train))


@query()
def boosted_fit(spark, d):
    """Trees with L1, L2 and shares of rows and columns."""
    t, train, _ = _parts(spark, d)
    return _scored(t, boosting.Boosted(trees=10, depth=3, rate=0.1, l1=0.1, l2=1.0, rows=0.85, columns=0.85).fit(train))


@query()
def boosted_importance(spark, d):
    """The share of each feature in the mean gains of splits."""
    t, train, _ = _parts(spark, d)
    found = boosting.Boosted(trees=5, depth=3, l1=0.1).fit(train).importances
    return spark.createDataFrame([(c, float(w)) for c, w in zip(FEATURES, found, strict=True)], "feature string, importance double")


@query()
def network_fit(spark, d):
    """A network stopped by the last tenth of the training rows in time."""
    t, train, _ = _parts(spark, d)
    return _scored(t, network.Network((8,), "tanh", l2=1e-3, most=60).fit(train))


@query()
def random_search(spark, d):
    t, train, _ = _parts(spark, d)
    space = {"maxDepth": [2, 3], "maxIter": [5, 10], "stepSize": [0.05, 0.1]}
    return sinks.cv_results(spark, models.expanding_cv(train, lambda p, n: models.trees(**p), models.draws(space, 3), folds=3))


@query()
def grid_search(spark, d):
    t, train, _ = _parts(spark, d)
    cs = [0.0001, 0.001, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 1000.0]
    return sinks.cv_results(spark, selection.ridge_cv(train, FEATURES, cs, folds=5))


@query()
def sigmoid_calibration(spark, d):
    t, train, _ = _parts(spark, d)
    model = models.calibrate(train, lambda n: models.logistic(0.1, n), folds=5)
    return model.transform(t).select("game", "split", F.col("label").cast("int").alias("label"), F.round("p", 6).alias("p"))


@query()
def permutation_importance(spark, d):
    t, train, test = _parts(spark, d)
    model = models.logistic(0.1, train.count()).fit(train)
    test = splits.positions(test.drop("position"), "date", ["game"])
    return importance.permutation_importance(test, model, FEATURES, "position").select("feature", F.round("importance", 6).alias("importance"))


@query()
def coef_ranking(spark, d):
    t, train, _ = _parts(spark, d)
    return models.coefficient_ranking(spark, models.logistic(0.1, train.count()).fit(train), FEATURES)


@query()
def tree_importance(spark, d):
    t, train, _ = _parts(spark, d)
    return models.tree_importance(spark, models.trees(maxIter=5, maxDepth=3).fit(train), FEATURES)


@query()
def backward_selection(spark, d):
    t, train, _ = _parts(spark, d)

    def recalibrated(columns):
        """Log loss on val of a model calibrated by folds of train."""
        own = models.assemble(t.drop("features"), columns)
        model = models.calibrate(own.where("split = 'train'"), lambda n: models.logistic(0.1, n), folds=3)
        return models.log_loss(model.transform(own.where("split = 'val'")))

    kept, gone = selection.backward_selection(train, FEATURES, c=0.1, folds=5, confirm=recalibrated)
    rows = [(c, True, None) for c in kept] + [(c, False, float(x)) for c, x in gone]
    return spark.createDataFrame(rows, "feature string, kept boolean, log_loss_without double")


@query()
def ensemble_report(spark, d):
    """Three calibrated models, blended by weights from val, then scaled, calibrated and
    retrained on train and val: one row of test metrics for each and for the blend."""
    t, _, _ = _parts(spark, d)
    raw = t.select("game", "date", "split", "label", *FEATURES)
    makers = {"lr": lambda n: models.logistic(0.1, n), "trees": lambda n: models.trees(maxIter=5, maxDepth=3, stepSize=0.1), "mlp": lambda n: models.perceptron(len(FEATURES), (8,), maxIter=50)}
    val, test = t.where("split = 'val'"), None
    for name, make in makers.items():
        model = models.calibrate(t.where("split = 'train'"), make, folds=3)
        val = model.transform(val, name)
        own = models.retrain_calibrated(raw, FEATURES, make, "date", ["game"], folds=3).where("split = 'test'")
        own = own.select("game", F.col("label").cast("int").alias("label"), F.lit(name).alias("model"), "p")
        test = own if test is None else test.unionByName(own)
    weights = dict(zip(makers, blend.simplex_weights(val, "label", list(makers)).weights, strict=True))
    w = F.coalesce(*[F.when(F.col("model") == m, F.lit(x)) for m, x in weights.items()])
    mixed = test.groupBy("game", "label").agg(F.sum(F.col("p") * w).alias("p")).select("game", "label", F.lit("ensemble").alias("model"), "p")
    long = stage(test.unionByName(mixed))
    scores = metrics.binary_metrics(long, "label", "p", ["model"]).join(metrics.roc_auc(long, "label", "p", ["model"]), "model")
    own = sinks.metrics_table(spark, {m: {"weight": x} for m, x in weights.items()})
    return scores.join(own, "model", "left")


@query()
def saved_blend(spark, d):
    """Chances of a blend that was fitted, saved, and loaded again."""
    makers = {"lr": lambda n: models.logistic(0.1, n), "trees": lambda n: models.trees(maxIter=5, maxDepth=3, stepSize=0.1)}
    raw = stage(training(spark, d)).drop("position")
    model = ensemble.fit_blend(raw, FEATURES, makers, "date", ["game"], folds=3)
    path = shared_dir(spark)
    model.write().save(path)
    out = ensemble.BlendModel.load(path).transform(raw)
    return out.select("game", "split", F.col("label").cast("int").alias("label"), *[F.round(c, 6).alias(c) for c in ("p_lr", "p_trees", "p")])

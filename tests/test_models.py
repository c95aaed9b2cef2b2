import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from presage.operators.metrics import evaluate
from presage.operators.sequences import flat_vector, lookback
from presage.plans import models
from presage.session import new_path, staged

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def planted(spark):
    """``a`` carries the signal, ``b`` some of it, ``c`` none."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1200):
        y = int(i % 6 == 0)
        rows.append((i, y, float(rng.normal(2 * y, 1)), float(rng.normal(0.5 * y, 1)), float(rng.normal())))
    df = staged(spark.createDataFrame(rows, "id long, y int, a double, b double, c double"), "planted")
    return df.where("id % 4 <> 1"), df.where("id % 4 = 1 OR id % 12 = 0")


def auc(df):
    return evaluate(df, "y", "score", 0.5).first()["roc_auc"]


def test_logistic(spark, planted):
    train, test = planted
    model = models.fit_logistic(train, FEATURES, "y", max_iter=100)
    scored = models.score(model, test)
    assert auc(scored) > 0.85
    table = models.coefficients(model, FEATURES, spark).collect()
    assert table[0]["feature"] == "a" and table[0]["value"] > 0
    path = new_path(spark, "model")
    model.write().overwrite().save(path)
    again = models.score(PipelineModel.load(path), test)
    assert scored.orderBy("id").collect() == again.orderBy("id").collect()


def test_trees_and_report(spark, planted):
    train, test = planted
    params = models.TreeParams(trees=8, depth=3, rate=0.2)
    model = models.fit_trees(train, ["id"], params, FEATURES, "y")
    assert auc(models.score(model, test)) > 0.8
    assert models.coefficients(model, FEATURES, spark).first()["feature"] == "a"
    row = models.tuned_report(models.score(model, train), models.score(model, test), "boosted_trees", "y").first()
    assert row["model"] == "boosted_trees" and 0.05 <= row["threshold"] <= 0.95 and row["n_test"] == test.count()


def test_tuning(spark, planted):
    train, _ = planted
    draws = [models.TreeParams(1, 3, 0.05, 0.6, 0.6), models.TreeParams(6, 3, 0.2, 0.9, 1.0)]
    trials, best = models.tune_trees(train, ["id"], draws, 2, FEATURES, "y")
    rows = trials.collect()
    assert len(rows) == 2 and rows[0]["mean_pr_auc"] >= rows[1]["mean_pr_auc"] > 0.3
    assert best.trees == rows[0]["trees"]
    final = models.refit_tuned(train, ["id"], best, min_trees=8, features=FEATURES, label="y")
    assert final.stages[-1].getMaxIter() == 8 and auc(models.score(final, planted[1])) > 0.75


def test_draws_are_fitted_side_by_side(spark, planted, monkeypatch):
    asked, real = [], models.CrossValidator
    monkeypatch.setattr(models, "CrossValidator", lambda **kw: (asked.append(kw["parallelism"]), real(**kw))[1])
    draws = [models.TreeParams(1, depth) for depth in (1, 2, 3)]
    found = [models.tune_trees(planted[0], ["id"], draws, 2, FEATURES, "y", **kw)[0].collect() for kw in ({}, {"parallelism": 1})]
    assert asked == [max(2, min(3, spark.sparkContext.defaultParallelism)), 1] and found[0] == found[1]


def test_draws_stay_in_their_ranges():
    draws = models.draw_params(50)
    assert draws == models.draw_params(50)
    assert all(100 <= d.trees < 600 and 3 <= d.depth < 10 and 0.01 <= d.rate <= 0.3 for d in draws)
    assert all(0.6 <= s <= 1.0 for d in draws for s in (d.row_share, d.feature_share))


def test_ablation(spark, planted):
    train, test = planted
    groups = {"strong": ("a",), "weak": ("b",), "noise": ("c",)}
    table = models.ablation(train, test, ["id"], models.TreeParams(trees=3, depth=3, rate=0.2), groups, FEATURES, "y")
    rows = {r["feature_group"]: r for r in table.collect()}
    assert set(rows) == {"strong", "weak", "noise", "all features"} and rows["all features"]["n_features"] == 3
    best = models.best_solo_group(table).first()
    assert best["feature_group"] == "strong"
    assert best["pct_of_full"] == pytest.approx(100 * rows["strong"]["roc_auc"] / rows["all features"]["roc_auc"])


def test_sequence_net(spark):
    rng = np.random.default_rng(4)
    rows = []
    for job in range(80):
        y = job % 2
        for w in range(6):
            rows.append((job, 0, w, float(rng.normal(y * w * 0.5, 0.5)), float(rng.normal()), y))
    df = lookback(spark.createDataFrame(
        rows, "job_id long, task_index long, window_start long, a double, b double, y int"), ["a", "b"], 3)
    df = staged(df, "sequences")
    model = models.fit_sequence_net(df, 3, 2, "y", hidden=8, max_iter=40)
    assert auc(models.score(model, flat_vector(df, output="raw"))) > 0.8


def test_sequence_net_stops_early(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(job, 0, 0, float(rng.normal()), float(rng.normal()), int(rng.random() < 0.5)) for job in range(200)]  # nothing to learn
    df = staged(lookback(spark.createDataFrame(
        rows, "job_id long, task_index long, window_start long, a double, b double, y int"), ["a", "b"], 2), "sequences")
    losses, real = [], models.log_loss
    monkeypatch.setattr(models, "log_loss", lambda *a: (losses.append(real(*a)), losses[-1])[1])
    model = models.fit_sequence_net(df, 2, 2, "y", hidden=16, max_iter=400, step=5, held_share=0.3)
    assert 3 <= len(losses) < 80 and min(losses) < losses[-1]
    held = models.random_holdout(flat_vector(df, output="raw"), ("job_id", "task_index"), 0.3, models.SEED).where("is_validation")
    assert real(model.transform(held), "y") == pytest.approx(min(losses))  # the best weights, not the last


def _stored_lengths(spark, monkeypatch, fit):
    """Rows of each partition of what a fit stores and passes over, on three cores."""
    stored, real = [], models.staged
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: 3))
    monkeypatch.setattr(models, "TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(models, "staged", lambda df, name: (stored.append(real(df, name)), stored[-1])[1])
    fit()
    return sorted(stored[-1].groupBy(F.input_file_name()).count().toPandas()["count"])


def _uneven(spark, n=1200):
    rows = spark.range(n).select(
        "id", F.lit(0).alias("task_index"), F.lit(0).alias("window_start"), (F.col("id") % 3 == 0).cast("int").alias("y"),
        *[F.rand(i).alias(c) for i, c in enumerate(FEATURES)])
    return staged(rows.where(F.col("id") < n - 100).coalesce(1).unionByName(rows.where(F.col("id") >= n - 100).repartition(4)), "uneven")


def test_net_passes_over_even_files(spark, monkeypatch):
    train = _uneven(spark).withColumn("sequence", F.array(F.array(*FEATURES)))
    found = _stored_lengths(spark, monkeypatch, lambda: models.fit_sequence_net(train, 1, 3, "y", 4, 1, ["id"], step=1))
    assert len(found) == 3 and sum(found) == 1200 and found[-1] - found[0] <= 16


def test_net_takes_rows_as_large_matrices(spark):
    train = _uneven(spark, 300).withColumn("sequence", F.array(F.array(*FEATURES)))
    assert models.fit_sequence_net(train, 1, 3, "y", 4, 1, ["id"], step=1).stages[-1].getBlockSize() == 512


def test_permutation_importance(spark, planted):
    train, test = planted
    model = models.fit_trees(train, ["id"], models.TreeParams(trees=8, depth=3, rate=0.2), FEATURES, "y")
    found = {r["feature"]: r["importance"] for r in models.permutation_importance(model, test, FEATURES, "y", ["id"]).collect()}
    assert set(found) == set(FEATURES) and found["a"] > 0.2 and found["a"] == max(found.values()) and abs(found["c"]) < 0.1


def test_slopes_are_flat_at_the_optimum(spark, planted):
    train, _ = planted
    model = models.fit_logistic(train, FEATURES, "y")
    assert all(abs(r["slope"]) < 1e-4 for r in models.logistic_slopes(model, train, "y").collect())
    early = models.fit_logistic(train, FEATURES, "y", max_iter=1)
    assert max(abs(r["slope"]) for r in models.logistic_slopes(early, train, "y").collect()) > 1e-3


def test_stored_model_and_its_facts(spark, planted):
    from presage.plans.jobs import StoredModel, load_model, save_model
    from presage.session import new_path

    train, test = planted
    path, fitted = new_path(spark, "model"), models.fit_trees(train, ["id"], models.TreeParams(trees=3, depth=2), FEATURES, "y")
    save_model(spark, StoredModel(fitted, tuple(FEATURES), 0.25, {"a": 1.5}), path)
    again = load_model(spark, path)
    assert (again.features, again.threshold, again.medians) == (tuple(FEATURES), 0.25, {"a": 1.5})
    both = models.score(again.model, models.score(fitted, test), "again")
    assert both.where("score <> again").count() == 0
